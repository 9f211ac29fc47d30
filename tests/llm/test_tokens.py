"""Encoders, counts, packing, token files and media against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quire.llm import bpe, media, packing, plain_ids, token_counts, token_files
from quire.llm.queries import vocabulary

ODD = ["a", "b", " ", "  ", "\n", "é", "the ", "\t", "<|endoftext|>", "<s>", "1", "22", "漢", "Σ", "in", "\x1c", "'s", "'", "é", "İ", "ing", "!!", ".", ",", "▁", "​", "᠎", "ß", "É", "ñ", "×", "\x00", "😀", "\r\n", "\x85", "\xa0"]
WORD, BYTE = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
PIECE = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 16))) for _ in range(n)]


LONG = " ".join(odd_texts(4000, 7)) + " word" * 50_000 + "x" * 3000


@pytest.fixture(scope="module")
def docs(spark):
    """Null and empty texts, a null id, repeated rows, a very long text, other columns with clashing names."""
    rows = [(k, t) for k, t in enumerate(odd_texts(150))] + [(1000, None), (1001, ""), (1002, LONG), (None, "no id"), (1003, "same"), (1003, "same"), (1004, "same")]
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, part string, ids int, number int")


def given(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def words(text):
    return WORD.encode(text, add_special_tokens=False).ids


def test_trie_equals_the_library():
    model = bpe.word_bpe(vocabulary("word_bpe_49k.json"))
    for text in [*odd_texts(4000, 11), LONG]:
        ids = [i for unit in model.encode_units(model.units(text)) for i in unit]
        assert ids == words(text)
        assert model.decode(ids) == WORD.decode(ids, skip_special_tokens=False)


def test_a_prefix_is_computed_once(monkeypatch):
    """Over several batches the trie has a node for each distinct prefix, and no more lookups than new nodes need."""
    model = bpe.WordBpe(vocabulary("word_bpe_49k.json"))
    batches = [["inter", "international", "internet"], ["interval", "internet", "into"], ["internationally", "zebra", "a"]]
    looked_up = []
    inner = model.inner

    class Counting(dict):
        def get(self, key, default=None):
            looked_up.append(key)
            return inner.get(key, default)

    monkeypatch.setattr(model, "inner", Counting())
    for batch in batches:
        assert model.encode_words(batch) == [words(w) for w in batch]
    prefixes = {w[:i] for batch in batches for w in batch for i in range(1, len(w))}
    assert len(model.tokens) - 1 == len(prefixes) == len(model.child)
    before = len(looked_up)
    for batch in batches:
        model.encode_words(batch)
    assert len(looked_up) == before
    monkeypatch.setattr(bpe, "NODES", 3)
    assert model.encode_words(["zebras"]) == [words("zebras")] and len(model.child) == 5


def test_pieces_that_span_a_space_are_refused():
    class Model:
        def get_piece_size(self):
            return 2

        def id_to_piece(self, i):
            return ["▁the", "of▁the"][i]

    with pytest.raises(ValueError, match="spans"):
        token_counts.check_pieces(Model())
    token_counts.check_pieces(PIECE)


def test_plain_encoders_equal_the_library():
    word = plain_ids.word_encoder(vocabulary("word_bpe_49k.json"))
    byte = plain_ids.byte_encoder(*token_files.vocabulary("byte_bpe_50k"))
    rng = random.Random(3)
    plain = ["a", "The ", "é", "É", "ß", "1", ".", ",", "..", "!?", "\n", " ", "\t", "-", "x", "ing", "ñ", "$"]
    for text in [*odd_texts(3000, 13), *["".join(rng.choice(plain) for _ in range(20)) for _ in range(3000)], LONG]:
        assert word.ids(text).tolist() == words(text)
        assert byte.ids(text).tolist() == BYTE.encode(text, add_special_tokens=False).ids


def test_digests(docs, spark):
    rows = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, vocabulary("word_bpe_49k.json")).collect())
    expected = []
    for doc_id, text in given(docs):
        ids = words(text)
        expected.append((doc_id or -1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(WORD.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows == sorted(expected)
    assert bpe.digests(docs.limit(0), vocabulary("word_bpe_49k.json")).collect() == []


def test_encode_and_decode_documents(docs):
    encoded = bpe.encode_documents(docs, vocabulary("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in bpe.decode_documents(encoded, vocabulary("word_bpe_49k.json")).collect()}
    assert all(texts[i] == WORD.decode(words(t), skip_special_tokens=False) for i, t in given(docs))


def test_counts(docs):
    rows = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, vocabulary("piece_bpe_32k.model")).collect())
    assert rows == sorted((i or -1, len(t.encode()), n := len(PIECE.encode(t)), n > 4096) for i, t in given(docs))
    assert token_counts.count_tokens(docs.limit(0), vocabulary("piece_bpe_32k.model")).collect() == []


def test_safe_units():
    for text in odd_texts(5000, 17):
        assert len(PIECE.encode(text)) == sum(len(PIECE.encode(u)) if u else 1 for u in token_counts.safe_units(text))


@pytest.mark.parametrize("total", [*range(1, 200), 2047, 2048, 2049, 4095, 4096, 4097, 8192, 10_000, 819, 820, 683, 1365, 1366])
def test_cut(total):
    pieces = packing.cut(total, 4096)
    assert sum(pieces) == total and all(0 < p <= 4096 for p in pieces) and all(p >= 32 for p in pieces[:-1])


def test_packing(docs):
    layout, pieces = packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=2, capacity=4096)
    rows = layout.collect()
    texts = {i: words(t) + [2] for i, t in given(docs)}
    by_document, by_sequence = {}, {}
    for r in rows:
        ids = texts[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.doc_tokens == len(texts[r.doc_id])
        by_document.setdefault(r.doc_id, []).append(r.length)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert all(sum(v) == len(texts[i]) * (2 if i == 1003 else 1) for i, v in by_document.items()) and set(by_document) == set(texts)
    for placed in by_sequence.values():
        at = 0
        for r in sorted(placed, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= total / 4096 * 1.02 + 1
    full = packing.sequences(layout, pieces).collect()
    assert all(len(s.ids) == 4096 for s in full) and sum(s.used for s in full) == total
    assert packing.pack(docs.limit(0), vocabulary("word_bpe_49k.json"))[0].collect() == []


def test_token_files(docs):
    files = token_files.write_token_files(docs, token_files.vocabulary("byte_bpe_50k"), end_id=2)
    rows = sorted(token_files.read_token_files(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in given(docs)), key=lambda i: -1 if i is None else i)
    texts, at = {i: [*BYTE.encode(t, add_special_tokens=False).ids, 2] for i, t in given(docs)}, 0
    for r in rows:
        ids = texts[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    empty = token_files.write_token_files(docs.limit(0), token_files.vocabulary("byte_bpe_50k"), end_id=2)
    assert token_files.read_token_files(empty).collect() == []


def test_token_files_layout(spark, sf, tmp_path):
    """Row groups of a set size, dictionary pages, page indexes, and reads of the small columns alone."""
    import glob

    import pyarrow.parquet as pq

    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionAll(spark.range(20_000).selectExpr("id + 10000 AS doc_id", "concat('word ', id) AS text"))
    files = token_files.write_token_files(documents, token_files.vocabulary("byte_bpe_50k"), end_id=2)
    paths = sorted(glob.glob(files.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0] + "/*.parquet"))
    last = -1
    for path in paths:
        with pq.ParquetFile(path) as f:
            assert f.read(["doc_id"]).column(0).to_pylist() == sorted(f.read(["doc_id"]).column(0).to_pylist())
            for g in range(f.metadata.num_row_groups):
                group = f.metadata.row_group(g)
                assert group.total_byte_size < 2 * token_files.ROW_GROUP_BYTES
                columns = {group.column(c).path_in_schema: group.column(c) for c in range(group.num_columns)}
                tokens = next(c for n, c in columns.items() if n.startswith("tokens"))
                assert tokens.has_dictionary_page and all(c.has_offset_index and c.has_column_index for c in columns.values())
                assert columns["doc_id"].statistics.min > last
                last = columns["doc_id"].statistics.max
    plan = files.filter("doc_id = 5").select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "tokens:array" not in plan.split("ReadSchema")[1] and "EqualTo(doc_id,5)" in plan


def test_token_files_of_a_shared_id(spark, request):
    """Very many rows of one doc_id and text are dealt out over several files."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    documents = spark.range(4000).selectExpr("CAST(7 AS LONG) AS doc_id", "'the same text' AS text")
    files = token_files.write_token_files(documents, token_files.vocabulary("byte_bpe_50k"), end_id=2)
    rows = token_files.read_token_files(files).collect()
    assert sorted(r.start for r in rows) == [k * rows[0].n_tokens for k in range(4000)]
    assert files.select("part").distinct().count() > 1


def test_media_of_small_shards(docs, monkeypatch):
    whole = sorted(tuple(r) for r in media.media_columns(docs.filter("doc_id IS NOT NULL")).collect())
    monkeypatch.setattr(media, "SHARD_BYTES", 3000)
    monkeypatch.setattr(media, "HELD_IDS", 7)
    small = sorted(tuple(r) for r in media.media_columns(docs.filter("doc_id IS NOT NULL")).collect())
    assert small == whole


def test_a_damaged_image_is_refused():
    image = bytearray(media.to_png(media.payload_of("some text")))
    image[45] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        media.from_png(bytes(image))


def test_media(docs):
    rows = media.media_columns(docs).collect()
    texts = {i: t.encode() for i, t in given(docs)}
    assert sorted(r.doc_id or -1 for r in rows) == sorted(i or -1 for i, _ in given(docs))
    for r in rows:
        payload = texts[r.doc_id] + b"\xff" * (-len(texts[r.doc_id]) % 576 or (0 if texts[r.doc_id] else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.width, r.height * r.width, r.bit_depth) == (576, len(payload), 8)
    assert len({(r.media_sha256, r.feature, r.media_bytes) for r in rows if texts[r.doc_id] == b"same"}) == 1
    assert media.media_columns(docs.limit(0)).collect() == []


def test_png_round_trip():
    for text in odd_texts(200, 19):
        payload = media.payload_of(text)
        assert len(payload) % 576 == 0 and len(payload) and media.from_png(media.to_png(payload)) == payload


def test_vocabularies_are_the_public_ones():
    assert vocabulary("word_bpe_49k.json") == public_tokenizers.path("word_bpe_49k.json")
