"""Fast encoders for plain texts, equal to the tokenizers library on them.

A rank-file encoder merges whichever neighbours form the token of lowest rank,
which is what the library's merge lists come to. Texts of ASCII and Latin-1
letters go to it whole; all others take the library's path.
"""

from __future__ import annotations

import base64
import json
import os
import re
from functools import lru_cache

import numpy as np

# Characters for which lower-casing, NFC and the classes of letters and digits need no tables.
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
#: Where one word ends and the next begins without white space between them.
_BOUNDARY = re.compile("(?<=[a-zß-öø-ÿ])(?=[^\\sa-zß-öø-ÿ])|(?<=[0-9])(?=[^\\s])|(?<=[^\\sa-z0-9ß-öø-ÿ])(?=[a-z0-9ß-öø-ÿ])")
#: Without these, full stops and commas stand alone and are the only signs.
_SIGNS = re.compile("[^a-zß-öø-ÿ\\s.,]|[.,][.,]")


class WordEncoder:
    """Ids of a vocabulary with word ends; the space after a word stands for its end."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = model["end_of_word_suffix"]
        letters = byte_letters()
        ranks = {}
        for token, i in model["vocab"].items():
            plain = token.removesuffix(end)
            ranks[bytes(letters[c] for c in plain) + (b" " if plain != token else b"")] = i
        # Single bytes have no merge, so their places in the order do not matter.
        self.plain = tiktoken.Encoding("words", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if not _PLAIN.fullmatch(text) or "'" in text or "<|" in text:
            return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<i4")
        lowered = text.lower()
        parted = _BOUNDARY.sub(" ", lowered) if _SIGNS.search(lowered) else lowered.replace(".", " . ").replace(",", " , ")
        words = parted.split()
        return np.array(self.plain.encode_ordinary(" ".join(words) + " ") if words else [], dtype="<i4")


class ByteEncoder:
    """Ids of a byte-level vocabulary, from the same vocabulary as a rank file."""

    def __init__(self, library_file: str, rank_file: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(library_file)
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if not _PLAIN.fullmatch(text) or "<|" in text:
            return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<i4")
        return np.array(self.plain.encode_ordinary(text), dtype="<i4")


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return WordEncoder(path)


@lru_cache(maxsize=1)
def byte_encoder(library_file: str, rank_file: str, pattern: str) -> ByteEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteEncoder(library_file, rank_file, pattern)
