"""Column expressions: text, tables, identifiers."""
