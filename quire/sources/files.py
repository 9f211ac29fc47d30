"""Discovery and reading of files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import FILE_TYPES
from quire.functions.text import base_name, extension

#: What Windows-1252 has in place of Latin-1's control characters.
CP1252 = tuple("".join(x) for x in zip(*[(chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)], strict=True))
SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def roots(spark: SparkSession, paths: list[str], recursive: bool = False) -> list[str]:
    """The files and folders that paths and globs name, in order, without those that lie in another of them: a file is then listed once.

    A path that names nothing stays, for the reader to refuse.
    """
    path_of, conf = spark._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    found: dict[str, bool] = {}
    missing = []
    for p in paths:
        path = path_of(p)
        names = path.getFileSystem(conf).globStatus(path)
        if not names:
            missing.append(p)
        for s in names or ():
            found[str(s.getPath())] = s.isDirectory()
    folders = {p for p, is_folder in found.items() if is_folder}

    def inside(p: str) -> bool:
        above = p.rsplit("/", 1)[0]
        if not recursive:
            return not found[p] and above in folders
        while above not in folders and "/" in above:
            above = above.rsplit("/", 1)[0]
        return above in folders

    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in sorted(found) if not inside(p)] + missing


def discover(spark: SparkSession, paths: list[str], recursive: bool = False, keep_unsupported: bool = False) -> DataFrame:
    """Files at paths, folders or globs, each once. Lock files (~$...) go, unsupported ones unless kept. Contents are read where they are used, and not shuffled."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(roots(spark, paths, recursive)).filter(~base_name(F.col("path")).startswith("~$"))
    return files if keep_unsupported else files.filter(extension(F.col("path")).isin(*FILE_TYPES))


def decoded(content: Column) -> Column:
    """(text, encoding): UTF-8 with or without a mark, else Windows-1252 where it has all bytes, else Latin-1."""
    text = content.cast("string")
    marked = F.hex(F.substring(content, 1, 3)) == "EFBBBF"
    gaps = F.hex(content).rlike("^(..)*?(81|8D|8F|90|9D)")  # bytes that Windows-1252 does not have
    utf8 = F.struct(F.regexp_replace(text, "^﻿", "").alias("text"), F.when(marked, "utf-8-sig").otherwise("utf-8").alias("encoding"))
    single = F.decode(content, "ISO-8859-1")
    cp1252 = F.struct(F.translate(single, *CP1252).alias("text"), F.lit("cp1252").alias("encoding"))
    latin = F.struct(single.alias("text"), F.lit("latin-1").alias("encoding"))
    return F.when(F.is_valid_utf8(text), utf8).when(~gaps, cp1252).otherwise(latin)
