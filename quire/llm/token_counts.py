"""Token counts: lengths only, from encoding in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import UnitCache, arrow_map, byte_slices

_SAFE = re.compile(r"(?<=[^ ▁]) ")
_SPANS = re.compile(r"[^ ▁][ ▁]")


def safe_units(text: str) -> list[str]:
    """Split a text at each space that follows another character; that space goes.

    The model itself writes a space as ▁, so this sign counts as one.
    No piece of the vocabulary holds a space after another character, so no
    token spans such a boundary, and the model puts a space before whatever it
    encodes. An empty unit stands for a space alone.
    """
    if not text:
        return []
    return _SAFE.split(text) if "  " in text or text[0] == " " or "▁" in text else text.split(" ")


def check_pieces(model) -> None:
    """Raise if a piece of the model holds a space after another character: units would not be safe."""
    for i in range(model.get_piece_size()):
        if _SPANS.search(model.id_to_piece(i)):
            raise ValueError(f"piece {model.id_to_piece(i)!r} spans a space")


def count_tokens(documents: DataFrame, model_file: str, limit: int = 4096, batch_chars: int = 1 << 16) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Texts are split at safe boundaries, the distinct units go to the library in
    batches of about `batch_chars` characters, and only their lengths are kept.
    A null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated
    rows; a null doc_id stays null; other columns are ignored; a very long text is
    looked up in segments; an empty table gives an empty one. A model with a piece
    that spans a space is refused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        check_pieces(model)
        cache = UnitCache(lambda units: [len(ids) if u else 1 for u, ids in zip(units, model.encode(units, num_threads=1), strict=True)], batch_chars=batch_chars)
        for batch, texts in byte_slices(batches, "text"):
            counts = [0] * len(texts)
            for k, found in cache.runs([safe_units(text) for text in texts]):
                counts[k] += sum(found)
            sizes = [len(text) if text.isascii() else len(text.encode()) for text in texts]
            n = np.array(counts, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(sizes, pa.int64()), pa.array(n), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return arrow_map(documents.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
