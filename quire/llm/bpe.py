"""BPE encoding and decoding by depth-first search of a trie of distinct words.

The encoding of a prefix ends in one token, its last-token state. It follows
from the states of shorter prefixes: the last token of a prefix is the one token
that ends it and that BPE keeps apart from the last token of what stands before
it. So a depth-first walk over the trie of all distinct words computes each
shared prefix once. Each Python worker keeps one trie for all its batches and
tasks; new words go into it in sorted order, which is that walk. A trie that has
outgrown its bound is planted anew.

Two neighbouring tokens are kept apart if, while both grow from symbols by their
merges, no merge across their boundary comes first. Merges are learned in rank
order, so a token's merges have rising ranks and one pass over the right edge of
the left token and the left edge of the right token decides it.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import UnitCache, arrow_map, byte_slices

NEVER = 1 << 60
#: Nodes that a trie has before it is planted anew: about 100 MB. What is encoded does not depend on it.
NODES = 500_000

# Fixed values of the vocabulary's own splitting pattern, for units of printable ASCII
# and the letters of Latin-1: these are their own NFC forms and lower-case one by one.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
# White space as Unicode has it; Python's own notion has four control characters more.
_WHITE = re.compile(r"[\t-\r \u0085   -     　]+")
_EXTRA = re.compile("[\x1c-\x1f]")


class WordBpe:
    """A vocabulary with word ends, read from a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.library = Tokenizer.from_file(path)
        model, self.end = data["model"], data["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(self.end)}
        self.last = {t.removesuffix(self.end): i for t, i in vocab.items() if t.endswith(self.end)}
        self.longest = max(map(len, [*self.inner, *self.last]))
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {vocab[a] << 20 | vocab[b]: k for k, (a, b) in enumerate(merges)}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for k, (a, b) in enumerate(merges):
            self.parts.setdefault(vocab[a + b], (vocab[a], vocab[b], k))
        self.right = self.edges(1)
        self.left = self.edges(0)
        self.letters = {c: self.library.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}
        stable = self.stable()
        self.inner = {t: i for t, i in self.inner.items() if i in stable}
        self.last = {t: i for t, i in self.last.items() if i in stable}
        self.pairs: dict[int, bool] = {}
        self.plant()
        self.word_cache = UnitCache(self.encode_mixed, limit=150_000, batch_chars=1 << 22)

    def edges(self, side: int) -> dict[int, list[tuple[int, int]]]:
        """For each token, the tokens at its right (1) or left (0) edge as it grows, each with the rank that ends it."""
        found: dict[int, list[tuple[int, int]]] = {}
        for token in self.text:
            chain, at, until = [], token, NEVER
            while True:
                chain.append((at, until))
                if at not in self.parts:
                    break
                until, at = self.parts[at][2], self.parts[at][side]
            found[token] = chain[::-1]
        return found

    def apart(self, a: int, b: int) -> bool:
        """Whether BPE, given the symbols of both tokens, ends with these two tokens."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self.kept(a, b)
        return known

    def kept(self, a: int, b: int) -> bool:
        left, right, i, j, rank = self.right[a], self.left[b], 0, 0, self.rank
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            r = rank.get(x << 20 | y, NEVER)
            if r < x_until and r <= y_until and r != NEVER:
                return False
            if x_until == NEVER == y_until:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def stable(self) -> set[int]:
        """Tokens that BPE makes of their own symbols: both parts are such tokens and no other merge comes between."""
        good: set[int] = {t for t in self.text if t not in self.parts}
        for token, (a, b, rank) in sorted(self.parts.items(), key=lambda x: x[1][2]):
            if a in good and b in good and self.joined(a, b, rank):
                good.add(token)
        return good

    def joined(self, a: int, b: int, rank: int) -> bool:
        """Whether the first merge across the boundary of `a` and `b` is the one that joins them."""
        left, right, i, j = self.right[a], self.left[b], 0, 0
        while i < len(left) - 1 or j < len(right) - 1:
            (x, x_until), (y, y_until) = left[i], right[j]
            r = self.rank.get(x << 20 | y, NEVER)
            if r < x_until and r <= y_until and r != NEVER:
                return False
            if x_until <= y_until:
                i += 1
            else:
                j += 1
        return self.rank.get(left[i][0] << 20 | right[j][0]) == rank

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of distinct words, given as the vocabulary's byte characters.

        The words go into the trie in sorted order, which is its depth-first walk.
        A new node gets its state from those above it; a known one, of this call
        or an earlier one, has it.
        """
        order = sorted(range(len(words)), key=words.__getitem__)
        out: list[list[int]] = [[]] * len(words)
        inner, last, pairs, apart, longest = self.inner.get, self.last.get, self.pairs, self.apart, self.longest
        if len(self.tokens) > NODES:
            self.plant()
        children, tokens, starts = self.child, self.tokens, self.starts
        child, new_token, new_start, size = children.get, tokens.append, starts.append, len(tokens)
        # The nodes from the root to where the walk is, and their states.
        path, token, start = [0], [-1], [0]
        before = ""
        for k in order:
            word = words[k]
            n, depth = len(word), 0
            top = min(len(path) - 1, n - 1, len(before))
            while depth < top and word[depth] == before[depth]:
                depth += 1
            del path[depth + 1 :], token[depth + 1 :], start[depth + 1 :]
            node, i = path[-1], depth + 1
            while i < n and (below := child(node << 21 | ord(word[i - 1]))) is not None:
                node = below
                path.append(node)
                token.append(tokens[node])
                start.append(starts[node])
                i += 1
            # Below a new node all are new.
            for i in range(i, n):
                for s in range(i - 1, i - longest - 1 if i > longest else -1, -1):
                    t = inner(word[s:i])
                    if t is not None and (s == 0 or pairs.get(key := token[s] << 20 | t) or key not in pairs and apart(token[s], t)):
                        break
                else:
                    raise ValueError(f"no encoding for a prefix of {word!r}")
                children[node << 21 | ord(word[i - 1])] = node = size
                size += 1
                new_token(t)
                new_start(s)
                path.append(node)
                token.append(t)
                start.append(s)
            for s in range(n - 1, max(-1, n - longest - 1), -1):
                t = last(word[s:])
                if t is not None and (s == 0 or pairs.get(key := token[s] << 20 | t) or key not in pairs and apart(token[s], t)):
                    break
            else:
                raise ValueError(f"no encoding for {word!r}")
            ids = [t]
            while s > 0:
                ids.append(token[s])
                s = start[s]
            out[k] = ids[::-1]
            before = word
        return out

    def plant(self) -> None:
        """An empty trie: by node and character the node below; by node the prefix's last token and where that starts."""
        self.child: dict[int, int] = {}
        self.tokens: list[int] = [-1]
        self.starts: list[int] = [0]

    def words(self, unit: str) -> list[str | int]:
        """Words (or ids of special tokens) of a unit without white space."""
        if unit.isascii() and unit.isalpha():
            return [unit.lower()]
        if _PLAIN.fullmatch(unit) and "<|" not in unit:
            found = _PLAIN_WORD.findall(unit.lower())
            return found if unit.isascii() else [w.translate(self.letters) for w in found]
        found = []
        for part in self.special_pattern.split(unit):
            if part in self.special:
                found.append(self.special[part])
            elif part:
                split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                found.extend(word for word, _ in split)
        return found

    def units(self, text: str) -> list[str]:
        """Runs without white space; no token spans two."""
        if _EXTRA.search(text):
            return [u for u in _WHITE.split(text) if u]
        return text.split()

    def encode_units(self, units: list[str]) -> list[list[int]]:
        split = [self.words(u) for u in units]
        flat = [w for ws in split for w in ws]
        ids = self.word_cache.learn(flat)
        return [[i for w in ws for i in ids[w]] for ws in split]

    def encode_mixed(self, words: list[str | int]) -> list[tuple[int, ...]]:
        """As encode_words; an id of a special token stands for itself."""
        plain = [w for w in words if isinstance(w, str)]
        ids = dict(zip(plain, map(tuple, self.encode_words(plain)), strict=True))
        return [ids[w] if isinstance(w, str) else (w,) for w in words]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, as the library does for a vocabulary without a decoder; unknown ids give nothing."""
        return " ".join(self.text[i] for i in ids if i in self.text)


@lru_cache(maxsize=1)
def word_bpe(path: str) -> WordBpe:
    """One vocabulary, and what it has encoded, for all tasks of a Python worker."""
    bpe = WordBpe(path)
    # Its tables stay for good, and caches hold no cycles: the collector need not walk them again and again.
    gc.freeze()
    gc.set_threshold(100_000, 50, 50)
    return bpe


def encode_documents(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        cache = UnitCache(bpe.encode_units, limit=250_000, batch_chars=1 << 22)
        for batch, texts in byte_slices(batches, "text"):
            lists: list[list[int]] = [[] for _ in texts]
            for k, found in cache.runs([bpe.units(text) for text in texts]):
                lists[k].extend(i for ids in found for i in ids)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return arrow_map(documents.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


@lru_cache(maxsize=1)
def digest_cache(vocabulary: str) -> tuple[WordBpe, UnitCache]:
    """A vocabulary and, for units, their numbers of tokens, ids and decoded tokens as bytes: for all tasks of a Python worker."""
    bpe = word_bpe(vocabulary)
    names = {i: b" " + t.encode() for i, t in bpe.text.items()}
    numbers = {i: b" %d" % i for i in names}

    def of_words(words: list[str | int]) -> list[tuple[int, bytes, bytes]]:
        return [(len(ids), b"".join([numbers[i] for i in ids]), b"".join([names[i] for i in ids])) for ids in bpe.encode_mixed(words)]

    def encode(units: list[str]) -> list[tuple[int, bytes, bytes]]:
        split = [bpe.words(u) for u in units]
        known = word_cache.learn([w for ws in split for w in ws])
        return [known[ws[0]] if len(ws) == 1 else joined([known[w] for w in ws]) for ws in split]

    def joined(found: list[tuple[int, bytes, bytes]]) -> tuple[int, bytes, bytes]:
        return sum([f[0] for f in found]), b"".join([f[1] for f in found]), b"".join([f[2] for f in found])

    word_cache = UnitCache(of_words, limit=150_000, batch_chars=1 << 22)
    return bpe, UnitCache(encode, limit=250_000, batch_chars=1 << 22)


def digests(documents: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Each distinct word is encoded and decoded once; a document's ids and decoded
    text are those of its units' words, one after the other. A null text counts as
    empty; repeated rows give repeated rows; a null doc_id stays null; other columns
    are ignored; a very long text is looked up in segments; an empty table gives an
    empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = digest_cache(vocabulary)
        for batch, texts in byte_slices(batches, "text"):
            rows = [[0, hashlib.sha256(), hashlib.sha256()] for _ in texts]
            for k, found in cache.runs([bpe.units(text) for text in texts]):
                row, skip = rows[k], 0 if rows[k][0] else 1
                row[0] += sum([f[0] for f in found])
                row[1].update(b"".join([f[1] for f in found])[skip:])
                row[2].update(b"".join([f[2] for f in found])[skip:])
            n, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array([x.hexdigest() for x in a]), pa.array([x.hexdigest() for x in b])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return arrow_map(documents.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
