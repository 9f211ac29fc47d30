"""Expressions on rows of tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import lines, strip


def row_is_empty(values: Column) -> Column:
    return F.forall(values, lambda v: v.isNull() | (v == ""))


def dedupe_headers(headers: Column, compat: bool = False) -> Column:
    """Headers made distinct: an empty one is column_i, the n-th repeat of h is h_n.

    A made name may meet a given one; it then takes the next free number. With
    `compat` it does not, and names may still be equal.
    """
    named = F.transform(headers, lambda h, i: F.when(strip(h) == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(strip(h)))

    def numbered(h: Column, i: Column) -> Column:
        n = F.size(F.filter(F.slice(named, 1, i + 1), lambda x: x == h))
        return F.when(n == 1, h).otherwise(F.concat(h, F.lit("_"), n.cast("string")))

    if compat:
        return F.transform(named, numbered)

    def step(done: Column, h: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(2), F.size(done) + 2), lambda n: F.concat(h, F.lit("_"), n.cast("string")))
        free = F.element_at(F.filter(tries, lambda t: ~F.array_contains(done, t) & ~F.array_contains(named, t)), 1)
        return F.concat(done, F.array(F.when(F.array_contains(done, h), free).otherwise(h)))

    return F.aggregate(named, F.array().cast("array<string>"), step)


def key_value_row(headers: Column, values: Column) -> Column:
    """header: value for each value that is not empty; values beyond the headers are column_i."""
    pairs = F.transform(values, lambda v, i: F.when(v.isNotNull() & (v != ""), F.concat(F.coalesce(F.get(headers, i), F.concat(F.lit("column_"), (i + 1).cast("string"))), F.lit(": "), v)))
    return F.array_join(F.filter(pairs, lambda p: p.isNotNull()), " | ")


def markdown_table(rows: Column) -> Column:
    """Rows (arrays of strings) as a Markdown table; the first is its header."""
    kept = F.filter(rows, lambda r: ~row_is_empty(r))
    width = F.array_max(F.transform(kept, F.size))

    def cell(value: Column) -> Column:
        return strip(F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))

    def line(row: Column, header: bool) -> Column:
        def at(i: Column) -> Column:
            value = F.coalesce(F.get(row, i), F.lit(""))
            return cell(F.when(value == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(value) if header else value)

        return F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), width - 1), at), " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.transform(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), lambda r: line(r, False))
    return F.when(F.size(kept) == 0, F.lit("")).otherwise(F.array_join(F.concat(F.array(line(kept[0], True), rule), body), "\n"))


def table_shape(text: Column) -> Column:
    """(rows, columns) of a Markdown table, the header among the rows, the rule not; null without two rows."""
    piped = F.filter(lines(text), lambda r: strip(r).startswith("|") & strip(r).endswith("|"))
    cells = F.transform(piped, lambda r: F.transform(F.split(F.regexp_replace(strip(r), r"^\|+|\|+$", ""), r"\|", -1), strip))
    rule = F.forall(F.get(cells, F.lit(1)), lambda c: F.regexp_replace(c, r"[-:\s]", "") == "")
    n = F.size(cells) - F.when(rule, 1).otherwise(0)
    return F.when(F.size(cells) >= 2, F.struct(n.alias("rows"), F.array_max(F.transform(cells, F.size)).alias("columns")))


def cell_text(value: Column, kind: str) -> Column:
    """A typed value as a cell's text: null is empty, booleans in lower case, times in ISO form."""
    if kind == "boolean":
        text = F.when(value, "true").when(~value, "false")
    elif kind == "date":
        text = F.date_format(value, "yyyy-MM-dd")
    elif kind.startswith("timestamp"):
        text = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    else:
        text = strip(value.cast("string"))
    return F.coalesce(text, F.lit(""))
