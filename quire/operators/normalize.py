"""Normalised blocks: text by type, positions renumbered, source references filled in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.ids import source_ref
from quire.functions.tabular import table_shape
from quire.functions.text import block_text, is_blank, parent_path


def normalize_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with normalised text and path and orders from 0; blocks left without text go (page breaks stay).

    source_ref is set from the location where it is null; table blocks get
    table_rows and table_columns where those are null.
    """
    text = block_text(F.col("text"), F.col("block_type"))
    # Filtered by the raw text: a filter on the normalised one would work it out twice.
    kept = blocks.filter(~is_blank(F.col("text")) | (F.col("block_type") == "page_break"))
    cleaned = kept.withColumn("text", text).withColumn("parent_path", parent_path(F.col("parent_path")))
    shape = F.when(F.col("block_type") == "table", table_shape(F.col("text")))
    order = Window.partitionBy("document_id").orderBy("block_order")
    ref = source_ref(*[F.col(c) for c in ("page_number", "slide_number", "sheet_name", "line_start", "line_end", "row_start", "row_end")])
    return (
        cleaned.withColumn("block_order", F.row_number().over(order) - 1)
        .withColumn("source_ref", F.coalesce("source_ref", ref))
        .withColumn("table_rows", F.coalesce("table_rows", shape["rows"]))
        .withColumn("table_columns", F.coalesce("table_columns", shape["columns"]))
    )
