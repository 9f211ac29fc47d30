"""Sources: files of several formats to rows of blocks."""
