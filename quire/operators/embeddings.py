"""Embedding providers: functions from texts to vectors of a fixed length, run in Arrow batches."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import ship


class Provider(Protocol):
    name: str
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingProvider:
    """Signed feature hashing of words, normalised. It needs no model and gives the same vectors everywhere."""

    def __init__(self, dimensions: int = 384):
        self.dimensions = dimensions
        self.name = f"hashing-{dimensions}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for k, text in enumerate(texts):
            for word in re.findall(r"\w+", text.casefold()):
                h = zlib.crc32(word.encode())
                out[k, (h >> 1) % self.dimensions] += 1.0 if h & 1 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed_column(rows: DataFrame, provider: Provider, text: str = "text", name: str = "embedding") -> DataFrame:
    """Rows with their texts' vectors; a blank text fails the query."""
    ship(rows.sparkSession)

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            texts = series.tolist()
            if any(t is None or not t.strip() for t in texts):
                raise ValueError("texts to embed must not be blank")
            yield pd.Series(list(provider.embed(texts)))

    return rows.withColumn(name, embed(F.col(text)))


def check_model(spark, known: DataFrame, provider: Provider) -> None:
    """Fails if the index was built with another model or other dimensions. `known` holds at most a few settings."""
    settings = {r["key"]: r["value"] for r in known.filter(F.col("key").isin("embedding_model", "embedding_dimensions")).collect()}
    if settings.get("embedding_model", provider.name) != provider.name:
        raise ValueError("the index has another embedding model")
    if int(settings.get("embedding_dimensions", provider.dimensions)) != provider.dimensions:
        raise ValueError("the index has other embedding dimensions")
