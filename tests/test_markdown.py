"""Markdown's containers and leaves, and front matter."""

import json

import pytest
from pyspark.sql import functions as F

from quire.sources import markdown as M

CASES = {
    "setext headings": ("Title\n=====\n\nlong\nheading\n---\ntext\n", [("heading", "Title", 1, 2), ("heading", "long heading", 4, 6), ("paragraph", "text", 7, 7)]),
    "lists in lists": ("- a\n  - b\n    rest\n    - c\n\n  more a\n- d\n", [("list_item", "a more a", 1, 1), ("list_item", "b rest", 2, 3), ("list_item", "c", 4, 4), ("list_item", "d", 7, 7)]),
    "lazy lines": ("- a\nlazy\n> quote\nlazy too\n\nnot lazy\n", [("list_item", "a lazy", 1, 2), ("paragraph", "quote lazy too", 3, 4), ("paragraph", "not lazy", 6, 6)]),
    "quotes": ("> one\n> two\n>\n> three\n> > deep\n\n> - item\n>   more\n", [("paragraph", "one two", 1, 2), ("paragraph", "three", 4, 4), ("paragraph", "deep", 5, 5), ("list_item", "item more", 7, 8)]),
    "numbers that interrupt": ("text\n2. no item\n1. an item\n", [("paragraph", "text 2. no item", 1, 2), ("list_item", "an item", 3, 3)]),
    "empty items": ("-\n  a\n-\n\n  b\n", [("list_item", "a", 2, 2), ("paragraph", "b", 5, 5)]),
    "code in an item": ("1. do\n   ```sh\n   x\n    y\n   ```\n2. done\n", [("list_item", "do", 1, 1), ("code", "x\n y", 2, 5), ("list_item", "done", 6, 6)]),
    "unclosed code": ("~~~\n# no heading\n```\n", [("code", "# no heading\n```", 1, 3)]),
    "code ends with its quote": ("> ```\n> x\ntext\n", [("code", "x", 1, 2), ("paragraph", "text", 3, 3)]),
    "indented code is no block": ("text\n    goes on\n\n    code\n\nend\n", [("paragraph", "text goes on", 1, 2), ("paragraph", "end", 6, 6)]),
    "rules": ("a\n\n***\n- - -\n_ _ _\nb\n", [("paragraph", "a", 1, 1), ("paragraph", "b", 6, 6)]),
    "tables": ("intro\n| a | b |\n|:--|--:|\n| 1 | 2 |\nrow\n\n| no | table |\n| - |\n", [("paragraph", "intro", 1, 1), ("table", "| a | b |\n|:--|--:|\n| 1 | 2 |\nrow", 2, 5), ("paragraph", "| no | table | | - |", 7, 8)]),
    "headings": ("#no\n\n# yes #\n##\n####### seven\n  ### three\n", [("paragraph", "#no", 1, 1), ("heading", "yes", 3, 3), ("paragraph", "####### seven", 5, 5), ("heading", "three", 6, 6)]),
    "definitions": ("[a]: /url 'title'\n[b]: <x y>\ntext [a]\n", [("paragraph", "text [a]", 3, 3)]),
    "tabs": ("-\ta\n\n\tb\n", [("list_item", "a b", 1, 1)]),
    "heading in an item": ("- # Head\n  text\n", [("list_item", "Head text", 2, 2), ("heading", "Head", 1, 1)]),
    "nothing": ("\n \n", []),
}


@pytest.mark.parametrize("name", CASES)
def test_blocks(name):
    text, wanted = CASES[name]
    assert [(b[1], b[2], b[5], b[6]) for b in M.blocks_of(text)] == wanted


def test_parent_paths():
    found = M.blocks_of("# A\n## B\ntext\n### C\n- item\n## D\n> # E\n\nlast\n")
    assert [(b[2], b[4]) for b in found] == [("A", []), ("B", ["A"]), ("text", ["A", "B"]), ("C", ["A", "B"]), ("item", ["A", "B", "C"]), ("D", ["A"]), ("E", []), ("last", ["E"])]


FRONT = """---
title: "Knowledge Base Metadata Title"
doc_type: "runbook"
version: 3.4.1
owners: [GridOps, DataOps]
tags: [rag-test, markdown]
count: 12
share: 0.5
draft: false
none: ~
people:
  - name: Ada   # comment
    langs:
      - fr
      - en
  - name: 'Li''s'
deep:
  a:
    b: {x: 1, "y z": [p, q]}
note: |
  first
    second
folded: >-
  one
  two
"quoted key": http://x.y/z
---
# Visible
"""


def test_front_matter(spark):
    docs = spark.createDataFrame([("1", FRONT), ("2", "# none\n---\n"), ("3", "---\n- a\n- b: 1\n...\ntext"), ("4", "---\n---\n"), ("5", "---\nnever closed\n"), ("6", None)], "document_id string, text string")
    found = {r.document_id: (json.loads(r.j), r.line_end) for r in M.front_matter(docs).select("document_id", F.to_json("front_matter").alias("j"), "line_end").collect()}
    assert found["1"] == (
        {
            "title": "Knowledge Base Metadata Title", "doc_type": "runbook", "version": "3.4.1", "owners": ["GridOps", "DataOps"], "tags": ["rag-test", "markdown"], "count": 12, "share": 0.5, "draft": False, "none": None,
            "people": [{"name": "Ada", "langs": ["fr", "en"]}, {"name": "Li's"}], "deep": {"a": {"b": {"x": 1, "y z": ["p", "q"]}}}, "note": "first\n  second\n", "folded": "one two", "quoted key": "http://x.y/z",
        },
        27,
    )
    assert found == {"1": found["1"], "3": ({"value": ["a", {"b": 1}]}, 4), "4": ({}, 2)}
    row = M.front_matter(docs).filter("document_id = '1'").select(M.field(F.col("front_matter"), "$.people[0].langs[1]").alias("lang"), M.field(F.col("front_matter"), "$.count", "int").alias("n"), M.field(F.col("front_matter"), "$.nowhere").alias("none")).first()
    assert tuple(row) == ("en", 12, None)
    assert [b[1:3] + b[5:6] for b in M.blocks_of(FRONT)] == [("heading", "Visible", 28)]


def test_blocks_of_documents_are_not_shuffled(spark):
    docs = spark.createDataFrame([("1", "# A\n\n- x\n"), ("2", None), ("3", "")], "document_id string, text string")
    blocks = M.markdown_blocks(docs)
    assert [(r.document_id, r.block_order, r.block_type, r.marker, r.indent) for r in blocks.orderBy("block_order").collect()] == [("1", 0, "heading", None, None), ("1", 1, "list_item", "-", 0)]
    assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()
