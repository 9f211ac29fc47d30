"""Text, table and identifier functions on worked examples."""

import hashlib
import json

from pyspark.sql import functions as F

from quire.functions import ids, tabular
from quire.functions import text as T
from quire.operators import validate


def value(spark, column, **given):
    names = list(given) or ["x"]
    row = spark.createDataFrame([tuple(given.values()) or (None,)], ", ".join(f"{n} {'array<string>' if isinstance(given.get(n), list) else 'string'}" for n in names))
    return row.select(column.alias("v")).first()["v"]


def test_strip_is_unicode(spark):
    assert value(spark, T.strip_text(F.col("x")), x="   a b \n ") == "a b"
    assert value(spark, T.strip_text(F.col("x")), x=" ﻿a ") == "a"
    assert value(spark, T.optional_text(F.col("x")), x="  ") is None


def test_block_text_by_type(spark):
    text = "  a   b \r\n\r\n   c\t\td  "
    assert value(spark, T.block_text(F.col("x"), F.lit("paragraph")), x=text) == "a b\nc d"
    assert value(spark, T.block_text(F.col("x"), F.lit("code")), x=text) == "a   b\n\n   c\t\td"
    assert value(spark, T.block_text(F.col("x"), F.lit("table")), x=text) == "a   b\n\nc\t\td"


def test_windows(spark):
    words = F.split("x", " ")
    row = spark.createDataFrame([("a b c d e f g",)], "x string").select(words.alias("w"))
    assert row.select(T.windows_of(F.col("w"), 3, 1).alias("v")).first()["v"] == ["a b c", "c d e", "e f g"]
    assert row.select(T.windows_of(F.col("w"), 10, 2).alias("v")).first()["v"] == ["a b c d e f g"]


def test_meaningful_tokens(spark):
    assert value(spark, T.meaningful_tokens(F.col("x")), x="How should the policies of Straße classes be normalized?") == ["policy", "strasse", "classe", "normalized"]


def test_missing_terms_fold_dashes_and_singulars(spark):
    text = "Incident P‑004 is kept 14‑day; human dispatcher; safety classifications"
    terms = F.array(F.lit("P-004"), F.lit("14 days"), F.lit("Human dispatchers"), F.lit("safety classification"), F.lit("absent"))
    row = spark.createDataFrame([(text,)], "x string").withColumn("form", T.match_form(F.col("x")))
    assert row.select(T.missing_terms(F.col("form"), terms).alias("v")).first()["v"] == ["absent"]



def test_excerpt_and_preview(spark):
    assert value(spark, T.excerpt(F.col("x"), 10), x="abc  def\nghi jkl") == "abc def..."
    assert value(spark, T.preview(F.col("x"), 3), x="abcd") == "abc..."


def test_url_title_names(spark):
    assert value(spark, T.redacted_url(F.col("x")), x="postgres://u:p@host/db") == "postgres://***@host/db"
    assert value(spark, T.session_title(F.col("x")), x="  a \n b ") == "a b"
    assert value(spark, T.stem(F.col("x")), x="/a/b.c.txt") == "b.c"
    assert value(spark, T.extension(F.col("x")), x="/a/B.TXT") == ".txt"
    assert value(spark, T.upload_name(F.col("x")), x="dir\\my file(1).pdf") == "my_file_1_.pdf"


def test_citations_outside_code(spark):
    assert value(spark, T.linked_citations(F.col("x")), x="a [1] `b [2]` [3](u) 【4†x】") == "a [1](#source-1) `b [2]` [3](u) [4](#source-4)"


def test_sse_round_trip(spark):
    events = value(spark, T.sse_parse(F.concat(T.sse_event(F.lit("delta"), F.lit("a")), F.lit("data: b\ndata: c\n\n"))))
    assert [(e["event"], e["data"]) for e in events] == [("delta", "a"), ("message", "b\nc")]


def test_headers_and_rows(spark):
    assert value(spark, tabular.dedupe_headers(F.col("x")), x=["a", "a", "", "a_2"]) == ["a", "a_3", "column_3", "a_2"]
    assert value(spark, tabular.dedupe_headers(F.col("x"), compat=True), x=["a", "a", "a_2"]) == ["a", "a_2", "a_2"]
    assert value(spark, tabular.key_value_row(F.col("h"), F.col("v")), h=["name", "score"], v=["Ada", "98", "x"]) == "name: Ada | score: 98 | column_3: x"


def test_markdown_table_and_shape(spark):
    rows = F.array(F.array(F.lit("Name"), F.lit("")), F.array(F.lit(""), F.lit("")), F.array(F.lit("a|b"), F.lit("2")))
    text = value(spark, tabular.markdown_table(rows))
    assert text == "| Name | column_2 |\n| --- | --- |\n| a\\|b | 2 |"
    assert tuple(value(spark, tabular.table_shape(F.col("x")), x="| Name | Score |\n| --- | --- |\n| a | 1 |")) == (2, 2)


def test_references(spark):
    none = F.lit(None).cast("int")
    ref = ids.source_ref(F.lit(3), none, F.lit("S"), F.lit(5), F.lit(7), F.lit(2), F.lit(2))
    assert value(spark, ref) == "page:3;sheet:S;lines:5-7;rows:2"
    assert value(spark, ids.source_ref(none, none, F.lit(None).cast("string"), none, F.lit(4), none, none)) == "lines:?-4"
    assert value(spark, ids.json_parent_path(F.col("x")), x="$.members[0].name") == ["$", "members", "[0]"]
    expected = hashlib.sha256("document\x1f\x1fa.txt\x1fA\x1ftxt".encode()).hexdigest()[:24]
    assert value(spark, ids.document_id(F.lit(None).cast("string"), F.lit("a.txt"), F.lit("A"), F.lit("txt"))) == expected


def test_metadata_of_any_depth(spark):
    kind = "struct<` name `:string,day:date,at:timestamp,price:decimal(6,2),tags:array<date>,more:map<string,struct<n:int,when:timestamp>>,none:string>"
    row = spark.sql(f"SELECT from_json('{{\" name \": \" x \", \"day\": \"2024-02-03\", \"at\": \"2024-02-03T04:05:06.007\", \"price\": 1.50, \"tags\": [\"2024-01-01\"], \"more\": {{\" k \": {{\"n\": 1, \"when\": \"2024-01-01T00:00:00\"}}, \" \": {{\"n\": 2}}, \"k\": {{\"n\": 3}}}}}}', '{kind}') AS m")
    found = json.loads(row.select(F.to_json(T.metadata_variant(F.col("m"), row.schema["m"].dataType))).first()[0])
    assert found == {"name": " x ", "day": "2024-02-03", "at": "2024-02-03T04:05:06.007000", "price": "1.50", "tags": ["2024-01-01"], "more": {"k": {"n": 3, "when": None}}, "none": None}
    empty = spark.sql("SELECT CAST(NULL AS MAP<STRING, INT>) AS m")
    assert empty.select(F.to_json(T.metadata_variant(F.col("m"), empty.schema["m"].dataType))).first()[0] == "{}"


def test_chunk_and_location_errors(spark):
    rows = spark.createDataFrame([("x", 1, [0], 1, 2), (" ", 1, [0], 1, 1), ("x", 0, [0], None, 3), ("x", 1, [], 3, 2), ("x", 1, None, 0, None)], "text string, n int, orders array<int>, a int, b int")
    found = rows.select(validate.chunk_error(F.col("text"), F.col("n"), F.col("orders"))["code"], validate.location_error(line=(F.col("a"), F.col("b")))["message"]).collect()
    assert [tuple(r) for r in found] == [(None, None), ("EMPTY_CHUNK_TEXT", None), ("INVALID_TOKEN_COUNT", None), ("MISSING_SOURCE_BLOCKS", "line ends before it begins"), ("MISSING_SOURCE_BLOCKS", "line numbers begin at 1")]
    documents = spark.createDataFrame([("a",), ("b",)], "document_id string")
    assert [r.document_id for r in validate.documents_without_blocks(documents, documents.limit(1)).collect()] == ["b"]
