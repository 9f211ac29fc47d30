"""Line dedup, classifiers, top-k search, near-duplicates and the pipeline against brute force."""

import base64
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import common, components, language, linededup, quality, queries, search, simhash


def words_of(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a null id, repeated rows, a long text, clashing columns."""
    rng = random.Random(1)
    rows = [(k, words_of(rng, 40)) for k in range(20)] + [(30, None), (31, ""), (32, " \n"), (33, words_of(rng, 60_000)), (None, "no id here"), (34, "twin text"), (34, "twin text"), (35, "12 34 !!")]
    return spark.createDataFrame([(i, t, "en", 1, 0.5, 7) for i, t in rows], "doc_id long, text string, lang string, fp int, score double, rejected int")


# line dedup


def brute_repeats(rows, least):
    """The lines with words, by document and number among them, of every run of `least` words or more that an earlier place has, by all pairs of places."""
    lines = [(i, k, x) for i, t in rows for k, x in enumerate(" ".join(x.split()) for x in (t or "").split("\n") if x.split())]
    gone = set()
    for b in range(len(lines)):
        for a in range(b):
            n = words = 0
            while b + n < len(lines) and lines[a + n][2] == lines[b + n][2] and lines[a + n][0] == lines[a][0] and lines[b + n][0] == lines[b][0]:
                words += len(lines[b + n][2].split())
                n += 1
            if words >= least:
                gone.update(lines[b + k][:2] for k in range(n))
    return gone


def lines_of(text):
    return [" ".join(x.split()) for x in (text or "").split("\n") if x.split()]


def deduped(spark, rows, **limits):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.text for r in linededup.drop_repeated_lines(docs, **limits).collect()}


def check_promise(spark, rows, noise=5, guarantee=8):
    """Every run of `guarantee` words that an earlier place has is gone, and no line that is in no such run of `noise` words."""
    got = deduped(spark, rows, noise=noise, guarantee=guarantee)
    must, may = brute_repeats(rows, guarantee), brute_repeats(rows, noise)
    for doc_id, text in rows:
        lines = lines_of(text)
        most = [x for k, x in enumerate(lines) if (doc_id, k) not in must]
        least = [x for k, x in enumerate(lines) if (doc_id, k) not in may]
        kept, rest = lines_of(got[doc_id]), iter(most)
        assert all(x in rest for x in kept), doc_id
        rest = iter(kept)
        assert all(x in rest for x in least), doc_id
    return must


@pytest.mark.parametrize(("noise", "guarantee"), [(5, 8), (25, 50), (1, 1), (3, 20)])
def test_line_dedup_keeps_its_promise(spark, noise, guarantee):
    rng = random.Random(13)
    pool = [words_of(rng, rng.randint(1, 25)) for _ in range(14)] + ["", " ", *[words_of(rng, 1) for _ in range(4)]]
    rows = []
    for k in range(70):
        at = rng.randint(0, 10)
        body = [rng.choice(pool) for _ in range(rng.randint(0, 10))] + pool[at : at + rng.randint(1, 6)]
        rows.append((k, "\n".join([*body, *[words_of(rng, 3) for _ in range(2)], *[rng.choice(pool) for _ in range(6)]])))
    assert len(check_promise(spark, rows, noise, guarantee)) > 50


def test_line_dedup_whatever_the_spacing(spark):
    """A run of 200 lines of a word each, three empty lines between them, goes whole where it is repeated."""
    rng = random.Random(14)
    run = [words_of(rng, 1) for _ in range(200)]
    start, end = words_of(rng, 30), words_of(rng, 30)
    rows = [(1, "\n\n\n\n".join(run)), (2, "\n".join([start, *run, end])), (3, start[::-1] + "\n" + "\n \n".join(run) + "\n\n" + end[::-1])]
    got = deduped(spark, rows)
    assert got[1] == rows[0][1] and lines_of(got[2]) == [start, end] and got[3] == f"{start[::-1]}\n\n{end[::-1]}"
    got = deduped(spark, rows, noise=25, guarantee=50)
    assert lines_of(got[2]) == [start, end]


def test_line_dedup_of_short_lines(spark):
    """A repeated line of 8 words goes from documents of any length."""
    line = "one two three four five six seven eight"
    rows = [(1, line), (2, line), (3, f"a\n{line}\nb"), (4, line.replace(" ", "  ")), (5, "one two three four"), (6, "one two three four"), (7, line[:-1])]
    assert deduped(spark, rows) == {1: line, 2: "", 3: "a\nb", 4: "", 5: rows[4][1], 6: rows[5][1], 7: line[:-1]}


def test_line_dedup_of_test_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    seen, kept = set(), deduped(spark, rows)
    for doc_id, _ in sorted(rows):
        for line in lines_of(kept[doc_id]):
            assert len(line.split()) < 8 or line not in seen
            seen.add(line)
    assert seen >= {x for _, t in rows for x in lines_of(t) if len(x.split()) >= 8}


def test_line_dedup_columns_and_nulls(spark):
    long_line = words_of(random.Random(2), 60)
    docs = spark.createDataFrame([(70, None, "e", "s"), (71, "", "e", "s"), (72, long_line, "e", "s"), (73, f"x\n{long_line}", "e", "s")], "doc_id long, text string, spans string, key string")
    out = linededup.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {70: None, 71: "", 72: long_line, 73: "x"}


def test_line_dedup_odd_inputs(spark, odd):
    got = sorted((r.doc_id or -1, r.text or "") for r in linededup.drop_repeated_lines(odd).collect())
    assert got == sorted((r.doc_id or -1, r.text or "") for r in odd.collect())
    assert linededup.drop_repeated_lines(odd.limit(0)).collect() == []


def test_line_dedup_where_the_first_position_stands_alone(spark):
    """B and C share a run whose middle line also stands in an earlier A among other lines."""
    rng = random.Random(12)
    rows, runs = [], []
    for k in range(12):
        x, g, y = (words_of(rng, n) for n in (20, 30, 20))
        a, b, c = ([words_of(rng, 15) for _ in range(4)] for _ in range(3))
        rows += [(3 * k, "\n".join([*a[:2], g, *a[2:]])), (3 * k + 1, "\n".join([*b[:2], x, g, y, *b[2:]])), (3 * k + 2, "\n".join([*c[:2], x, g, y, *c[2:]]))]
        runs.append((x, g, y))
    got = {i: t.split("\n") for i, t in deduped(spark, rows, noise=25, guarantee=50).items()}
    for k, run in enumerate(runs):
        assert not set(run) & set(got[3 * k + 2])
        assert run[0] in got[3 * k + 1] and run[1] in got[3 * k]
    assert all(len(got[3 * k + 2]) == 4 for k in range(12))


# near-duplicates


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_fingerprints(spark, odd):
    got = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(odd.filter("doc_id IS NULL OR doc_id <> 33")).collect()}
    assert all(got[r.doc_id] == f"{brute_fingerprint(r.text):016x}" for r in odd.collect() if r.doc_id != 33)
    assert got[30] == got[31] == got[32] == "0" * 16
    assert simhash.near_duplicates(odd.limit(0)).collect() == []


@pytest.mark.parametrize(("m", "distance"), [(4, 4), (3, 4), (5, 4), (6, 4), (2, 3), (2, 4), (5, 8)])
def test_links_equal_brute_force(spark, m, distance):
    rng = np.random.default_rng(m)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    values = set(base.tolist())
    for b in base[:20]:
        x = int(b)
        for _ in range(12):
            x ^= sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 6), replace=False))
            values.add(x)
    for k in range(200):  # one large group
        values.add(int(base[0]) ^ (1 << k % 64) ^ (1 << k * 7 % 64))
    values = sorted(values)
    nodes = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    found = simhash.links(nodes, distance, (m,), largest=64)
    got = [(int(np.int64(r.u).view(np.uint64)), int(np.int64(r.v).view(np.uint64))) for r in found.collect()]
    assert all((a ^ b).bit_count() <= distance for a, b in got)
    brute = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= distance]
    assert brute_components(got, values) == brute_components(brute, values)
    assert len(got) < 25 * len(values)


def test_more_rows_get_wider_parts():
    sample = np.sort(np.random.default_rng(5).integers(0, 1 << 64, 2000, dtype=np.uint64))
    chosen = [simhash.partition(sample, 4, rows, simhash.PARTS) for rows in (0, 10**4, 10**8, 10**10)]
    widths = [len(parts) for parts, _ in chosen]
    assert widths[0] == 5 and widths == sorted(widths, reverse=True) and widths[-1] < 4
    for parts, limits in chosen:
        assert sorted(b for p in parts for b in p) == list(range(64)) and sum(limits) == 4 - len(parts) + 1


def test_components(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)] + [(5, 5), (1, 0)]
    got = {r.node: r.root for r in components.roots(spark.createDataFrame(pairs, "u long, v long")).collect()}
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    assert got == brute_components([p for p in pairs if p[0] != p[1]], nodes)
    assert components.roots(spark.createDataFrame([], "u long, v long")).collect() == []


def test_component_ids(spark, odd):
    """component_id end to end, against all pairs of the brute-force fingerprints."""
    rng = random.Random(21)
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 33]
    for k in range(12):
        base = words_of(rng, 60).split()
        for j in range(8):
            base[rng.randrange(60)] = words_of(rng, 1)
            rows.append((1000 - 10 * k - j, " ".join(base)))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    marks = [brute_fingerprint(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (marks[a] ^ marks[b]).bit_count() <= 4]
    top, first = brute_components(pairs, range(len(rows))), {}
    for k, (doc_id, _) in enumerate(rows):
        first[top[k]] = min((x for x in (first.get(top[k]), doc_id) if x is not None), default=None)
    expected = sorted((i if i is not None else -1, f"{marks[k]:016x}", first[top[k]]) for k, (i, _) in enumerate(rows))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in got) == expected
    assert len({c for _, _, c in expected}) < len({f for _, f, _ in expected})


def shingle_set(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def test_one_of_each_by_similarity(spark):
    """Planted pairs: nearly all of 0.85 or more are caught, none under 0.8 is."""
    rng = random.Random(22)
    rows, alike, apart = [], [], []
    for k in range(300):
        a = words_of(rng, rng.randint(60, 300)).split()
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 20)):
            b[rng.randrange(len(b))] = words_of(rng, 1)
        x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
        share = len(x & y) / len(x | y)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        (alike if share >= 0.85 else apart if share < 0.8 else []).append(2 * k + 1)
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(alike) > 40 and len(apart) > 40
    assert {2 * k for k in range(300)} <= kept
    assert sum(i not in kept for i in alike) > 0.93 * len(alike)
    assert all(i in kept for i in apart)


def test_jaccard_of_sketches():
    rng = np.random.default_rng(23)
    x = rng.integers(0, 1 << 63, 9000, dtype=np.uint64)
    a, b = np.unique(x[:8000]), np.unique(x[1000:])
    assert abs(simhash.jaccard(a[:1024], b[:1024], 1024) - 7 / 9) < 0.05
    assert simhash.jaccard(a[:300], a[:300], 1024) == 1 and simhash.jaccard(a[:0], b[:0], 1024) == 1
    assert simhash.jaccard(a[:100], a[50:150], 1024) == 1 / 3


def test_one_of_each(spark, odd):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect())
    assert ids.count(34) == 1 and len([i for i in ids if i in (30, 31, 32)]) == 1 and -1 in ids and len(ids) == 25
    assert simhash.one_of_each(odd.limit(0)).collect() == []


def test_one_of_each_leaves_no_similar_pair_out(spark):
    """Chains of short texts, each with a similarity of 0.8 or more to the next: fingerprints of so few shingles are often far apart, and ends of chains are not alike."""
    rng = random.Random(31)
    rows, groups = [], []
    for k in range(150):
        words = words_of(rng, 12 + 2 * (k % 3)).split()
        groups.append([3 * k + n for n in range(3)])
        rows += [(3 * k + n, " ".join(words + [f"x{k}y{j}" for j in range(2 * n)])) for n in range(3)]
    sets = {i: shingle_set(t) for i, t in rows}
    assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for g in groups for a, b in zip(g, g[1:], strict=False))
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert kept == {g[0] for g in groups}


# search


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 12)) / 4
    x[100:400] = x[0]  # a very common vector, so many ties
    x[500:520] = 0
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [(1000, None), (1001, [float("nan")] * 12), (1002, [None] * 12), (1020, [float("inf")] * 12), (1040, [0.1] * 5), (1060, []), (None, [0.1] * 12)]
    v = search.integer_vectors(spark.createDataFrame([(i, e, 3) for i, e in rows], "vec_id long, embedding array<double>, score int"))
    got = sorted(tuple(r) for r in search.top_k(v.repartition(3), v.filter("vec_id % 20 = 0"), 20).collect())
    whole = np.floor(64 * x).astype(int)
    expected = []
    for q in range(0, 900, 20):
        best = sorted((-int(whole[q] @ whole[k]), k) for k in range(900) if k != q)[:20]
        expected += [(q, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert got == sorted(expected)
    few = search.top_k(v.filter("vec_id < 3"), v.filter("vec_id = 0"), 20).collect()
    assert sorted(r["rank"] for r in few) == [1, 2] and {r["vec_id"] for r in few} == {1, 2}
    assert search.top_k(v.limit(0), v.limit(0), 20).collect() == []


def test_top_k_in_many_cells(spark, monkeypatch):
    """Several blocks of candidates and of queries give what one of each does."""
    rng = np.random.default_rng(16)
    rows = [(k, [int(c) for c in v]) for k, v in enumerate(rng.integers(-30, 30, (1200, 10)))]
    v = spark.createDataFrame(rows, "vec_id long, v array<long>")
    whole = sorted(tuple(r) for r in search.top_k(v, v.filter("vec_id % 7 = 0"), 5).collect())
    monkeypatch.setattr(search, "CANDIDATE_BYTES", 20_000)
    monkeypatch.setattr(search, "QUERY_BYTES", 3_000)
    dealt = search.cells(v, v.filter("vec_id % 7 = 0"))
    assert dealt.select("cb").distinct().count() >= 4 and dealt.select("qb").distinct().count() >= 4
    assert sorted(tuple(r) for r in search.top_k(v, v.filter("vec_id % 7 = 0"), 5).collect()) == whole


def test_top_k_of_repeated_rows(spark):
    v = spark.createDataFrame([(1, [3, 1])] * 4 + [(2, [2, 2]), (3, [1, 0])], "vec_id long, v array<long>")
    got = [tuple(r) for r in search.top_k(v, v.filter("vec_id = 3"), 3).orderBy("rank").collect()]
    assert got == [(3, 1, 1, 3), (3, 2, 1, 3), (3, 3, 1, 3)]
    with pytest.raises(Exception, match="2\\*\\*53"):
        big = spark.createDataFrame([(1, [1 << 40, 0]), (2, [1 << 40, 1])], "vec_id long, v array<long>")
        search.top_k(big, big, 1).collect()


def test_reading_stops_by_the_data():
    """Lists with few large contributions are hardly read; lists of chance are, and either way few candidates are resolved."""
    rng = np.random.default_rng(8)
    ids, n = np.arange(-5, 0), 4000
    steep = np.rint(1000 / (1 + rng.permuted(np.tile(np.arange(n), (6, 1)), axis=1).T)).astype(np.int64)
    even = rng.integers(-30, 30, (n, 32))
    shares = []
    for x in (steep, even):
        q = np.abs(rng.integers(1, 30, (5, x.shape[1])))
        work = search.Work()
        best = search.search(ids, q, np.arange(n), np.ones(n, np.int64), x, 10, work)
        exact = q @ x.T
        for i in range(5):
            order = np.lexsort((np.arange(n), -exact[i]))[:10]
            assert (best.vec[i] == order).all() and (best.score[i] == exact[i, order]).all()
        shares.append(work.read / work.entries)
        assert work.resolved < 5 * n * 0.15
    assert shares[0] < 0.3 < shares[1] < 1


def test_queries_read_the_lists_together():
    """Sixteen times the queries cost far less than sixteen times the CPU seconds, and few candidates are resolved for each."""
    rng = np.random.default_rng(9)
    n, k = 8000, 20
    x = np.floor(8 * rng.normal(size=(n, 64))).astype(np.int64)
    took = []
    for m in (20, 320):
        seconds = []
        for _ in range(3):
            work, began = search.Work(), time.process_time()
            search.search(np.arange(m), x[:m], np.arange(n), np.ones(n, np.int64), x, k, work)
            seconds.append(time.process_time() - began)
        took.append(min(seconds))
        assert work.resolved <= m * 4 * k * len(list(search.blocks(n)))
    assert took[1] < 7 * took[0]


@pytest.mark.parametrize(("n", "d", "most", "k"), [(1, 3, 9, 4), (7, 1, 2, 3), (530, 5, 3, 20), (700, 4, 1 << 20, 5), (1300, 6, 40_000, 700), (600, 3, 0, 2)])
def test_search_of_odd_blocks(monkeypatch, n, d, most, k):
    """Ties, zero queries, repeated ids and rows, fewer candidates than k, several tiles, large components."""
    monkeypatch.setattr(search, "TILE", 3)
    monkeypatch.setattr(search, "PAIRS", 50)
    rng = np.random.default_rng(n)
    x, copies, vec = rng.integers(-most, most + 1, (n, d)), rng.integers(1, 4, n), rng.permutation(n) // 2
    q, ids = np.concatenate([x[:6], np.zeros((2, d), np.int64)]), np.concatenate([vec[:6], [-1, -2]])
    best = search.search(ids, q, vec, copies, x, k)
    for i in range(len(q)):
        others = np.repeat(np.flatnonzero(vec != ids[i]), copies[vec != ids[i]])
        expected = sorted((-int(s), int(v)) for s, v in zip(x[others] @ q[i], vec[others], strict=True))[:k]
        assert [(-int(s), int(v)) for s, v in zip(best.score[i], best.vec[i], strict=True) if s > search.NONE] == expected


# classifiers


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs, queries.fold(3) != 1)
    rows = language.predict(docs, model).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert np.mean([r.rejected for r in rows]) < 0.01 and all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("unseen", ["de", "en", "es", "fr"])
def test_language_unseen_is_rejected(spark, unseen):
    """Nearly all texts of a language left out of the fit are rejected, nearly all others accepted, cut short or not."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language.fit(docs, (queries.fold(3) != 1) & (F.col("lang") != unseen))
    held = docs.filter((queries.fold(3) == 1) & F.col("text").rlike("[a-zA-Z]")).select("lang", "text")
    short = held.select("lang", F.substring("text", 1, 60).alias("text")).filter("text rlike '[a-z]{3} [a-z]{3}'")
    for rows, most_known in ((language.predict(held, model).collect(), 0.01), (language.predict(short, model).collect(), 0.03)):
        assert np.mean([r.rejected for r in rows if r.lang != unseen]) < most_known
        if most_known == 0.01:
            assert np.mean([r.rejected for r in rows if r.lang == unseen]) > 0.97


def test_language_noise_is_rejected(spark):
    """Random letters, encoded bytes, code and languages that no text was labelled with, at any length."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language.fit(docs, queries.fold(3) != 1)
    rng = random.Random(31)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (4, 20, 200, 3000) for _ in range(20)]
    noise += [base64.b64encode(rng.randbytes(n)).decode() for n in (40, 600, 20_000) for _ in range(20)] + [rng.randbytes(n).hex() for n in (40, 6000) for _ in range(20)]
    noise += ["for (int i = 0; i < n; i++) { if (x[i] > y) { return foo_bar(baz, qux); } else { printf(i); } }" * n for n in (1, 20)]
    noise += ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", "Все люди рождаются свободными и равными в своем достоинстве и правах.", "人人生而自由,在尊严和权利上一律平等。"]
    gone = model.predict(noise)[2]
    assert gone.mean() > 0.93 and all(g for g, t in zip(gone, noise, strict=True) if len(t) > 500)


def brute_language(text, model):
    """Language and cosine from a dictionary of grams, one at a time."""
    lowered = "".join(c.lower() if not c.isascii() or c.isalpha() else " " for c in text) if not text.isascii() else re.sub("[^a-z]", " ", text.lower())
    data = (" " + " ".join(lowered.split(" ")) + " ").encode()
    data = b" " + b" ".join(data.split()) + b" "
    found = {}
    for n, salt in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
        for i in range(len(data) - n + 1):
            at = (int.from_bytes(data[i : i + n], "big") * salt % (1 << 32)) >> 20
            found[at] = found.get(at, 0) + 1
    x = {k: n**0.5 * float(model.idf[k]) for k, n in found.items()}
    size = sum(v * v for v in x.values()) ** 0.5
    cosines = [sum(v * float(c[k]) for k, v in x.items()) / size for c in model.centroids]
    best = max(range(len(cosines)), key=lambda k: cosines[k])
    return model.languages[best], min(max(cosines[best], 0.0), 1.0)


def test_language_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs, queries.fold(3) != 1)
    rows = [r for r in language.predict(docs, model).collect() if r.lang_pred != "und" and len(r.text) < 5000]
    assert len(rows) > 100
    for r in rows:
        lang, cosine = brute_language(r.text, model)
        assert abs(cosine - r.score) < 1e-4 and (lang == r.lang_pred or cosine - r.score < 1e-4)


def test_language_sample_stays_bounded(spark):
    """Very many lang values make no sample grow."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('some words of text ', id) AS text", "CAST(id AS STRING) AS lang")
    model = language.fit(docs, F.lit(True), most=300)
    assert 100 < len(model.languages) < 600


def test_language_counts_of_very_long_texts(spark):
    """Counts over 65,535 are kept as they are in the fit."""
    rows = [(k, "en", "the " * 200_000 + "quick brown fox " * 50_000) for k in range(2)] + [(k, "de", "der schnelle braune fuchs " * 3) for k in range(2, 4)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"), F.lit(True))
    assert model.predict([rows[0][2]])[1][0] > 0.9999


def test_language_odd_inputs(spark, odd):
    model = language.fit(odd, F.lit(True))
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in language.predict(odd, model).collect()}
    assert all(got[i] == ("und", True) for i in (30, 31, 32, 35)) and got[0][0] == "en"
    assert language.accepted(odd, model).columns == odd.columns
    nothing = language.fit(odd.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.predict(odd, nothing).collect()} == {"und"}
    assert language.predict(odd.limit(0), model).collect() == []


def test_language_counts_in_blocks(monkeypatch):
    text = words_of(random.Random(3), 400_000)
    whole = np.zeros(language.BUCKETS, np.int64)
    data = np.frombuffer((" " + text + " ").encode(), np.uint8).astype(np.uint32)
    for grams, salt in ((data[:-1] << np.uint32(8) | data[1:], 0x9E3779B1), ((data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:], 0x85EBCA6B)):
        whole += np.bincount((grams * np.uint32(salt)) >> np.uint32(20), minlength=language.BUCKETS)
    assert (language.counts(text) == whole).all()


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, ~queries.fold(5).isin(0, -1))
    held = docs.join(labels.filter(queries.fold(5) == 0), "doc_id")
    rows = quality.predict(held, model).select("quality", "score", "predicted").collect()
    good, bad = ([r.predicted for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_quality_counts_the_whole_of_long_words():
    """Texts without spaces that agree on a prefix differ by what follows it."""
    start = "aB3-" * 30
    texts = [start, start + "lower" * 50, start + "!?" * 200, start + "A1b2#" * 1000]
    assert len({v.tobytes() for v in quality.vectors(texts)}) == 4
    assert quality.vectors(["x" * 64_000])[0, : quality.SHAPES].sum() == 1000
    assert quality.shape("a1" * 6 + "!") != quality.shape("a1" * 6)


def test_quality_equals_brute_force(spark, sf):
    """Votes from a document at a time, all labelled documents sorted by cosine."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, ~queries.fold(5).isin(0, -1))
    assert len(model.known) > 20 and np.allclose(np.linalg.norm(model.known, axis=1), 1, atol=1e-5)
    for r in quality.predict(docs.limit(120), model).collect():
        raw = quality.vectors([r.text or ""])[0].astype(np.float64)
        x = np.sqrt(raw / max(raw[: quality.SHAPES].sum(), 1)) * model.idf
        x[-quality.TERMS :] *= quality.TERM_WEIGHT
        z = (x / max(np.linalg.norm(x), 1e-12)) @ model.axes
        z = z / max(np.linalg.norm(z), 1e-12)
        cosines = sorted(((float(k @ z), label) for k, label in zip(model.known, model.labels, strict=True)), reverse=True)
        near = cosines[: model.neighbours]
        if len(cosines) > len(near) and near[-1][0] - cosines[len(near)][0] < 1e-6:
            continue  # a tie in the last place
        votes = [max(c, 0.0) ** 4 + 1e-9 for c, _ in near]
        assert abs(sum(v * label for v, (_, label) in zip(votes, near, strict=True)) / sum(votes) - r.score) < 1e-3


def test_quality_counts_are_of_the_whole_text():
    text = "Aa bb, cc. " * 3 + "last"
    v = quality.vectors([text])[0]
    words = text.split()
    shapes, terms = np.zeros(quality.SHAPES), np.zeros(quality.TERMS)
    for w in words:
        kinds = re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in w))
        shapes[zlib.crc32(kinds.encode()) % quality.SHAPES] += 1
        terms[zlib.crc32(w.lower().encode()) % quality.TERMS] += 1
    assert (v[: quality.SHAPES] == shapes).all() and (v[-quality.TERMS :] == terms).all()
    at = quality.SHAPES + quality.PAIRS
    assert v[at + 3] == sum(a == b for a, b in zip(words, words[3:], strict=False)) == 6


def test_reserved_columns_whatever_their_case(spark, odd):
    renamed = odd.withColumnRenamed("score", "Score").withColumnRenamed("rejected", "REJECTED")
    assert language.predict(renamed, language.fit(odd, F.lit(True))).select("score", "rejected").count() == odd.count()
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    assert quality.predict(renamed, quality.fit(odd, labels, F.lit(True))).select("score").count() == odd.count()


def test_quality_odd_inputs(spark, odd):
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(odd, labels, F.lit(True))
    assert len(model.known) == 3
    rows = quality.predict(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert quality.accepted(odd, model).columns == odd.columns
    none = quality.fit(odd, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.predict(odd, none).collect()} == {0.5}
    assert quality.predict(odd.limit(0), model).collect() == []


def test_samples_stay_bounded(spark):
    """A doc_id that a third of the rows share, or null, makes no sample grow."""
    hot = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).when(F.col("id") % 2 > 0, F.lit(7)).alias("doc_id"), F.lit("some words of a text").alias("text"), F.lit("en").alias("lang"))
    labels = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(F.lit(7)).alias("doc_id"), F.lit(1).alias("quality"))
    assert len(quality.fit(hot, labels, F.lit(True), most=200).known) < 300
    assert language.fit(hot, F.lit(True)).languages


def test_samples_of_very_many_rows_stay_bounded(spark):
    """A share below 2^-20 is not rounded up."""
    rows = spark.range(8_000_000).withColumnRenamed("id", "doc_id")
    assert language.bounded_sample(rows, "doc_id", 2).count() <= 4
    assert rows.filter(common.below(F.xxhash64("doc_id"), 2.0**-30)).count() <= 2
    half = rows.limit(1000).filter(common.below(F.xxhash64("doc_id"), 0.5)).count()
    assert 400 < half < 600 and rows.limit(100).filter(common.below(F.xxhash64("doc_id"), 1.0)).count() == 100


def test_line_dedup_of_a_shared_id(spark):
    """Different texts under one doc_id, or under none, each lose their own runs alone."""
    rng = random.Random(12)
    passage = words_of(rng, 80)
    rows = [(i, f"{passage}\n{words_of(rng, 30)}") for i in (1, 1, None, None)]
    rows += [(1, words_of(rng, 70)), (None, words_of(rng, 70))]
    got = [r.text for r in linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum(passage in t for t in got) == 1
    assert sorted(t.split("\n")[-1] for t in got) == sorted(t.split("\n")[-1] for _, t in rows)


# shared folder


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


# pipeline


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/test-{name.replace(' ', '-')}")
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_pipeline_of_odd_rows(spark, odd, sf):
    """Each stage takes nulls, empty and very long texts, repeated rows, clashing columns, and no rows at all."""
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count(), name
        _, pack = corpus_pipeline.STAGES[-1]
        pieces = pack(spark, docs, sf).collect()
        assert sorted({-1 if r.doc_id is None else r.doc_id for r in pieces}) == sorted({-1 if r.doc_id is None else r.doc_id for r in docs.collect()})
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, odd, sf).collect()}
    assert not kept & {30, 31, 32, 35}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_top_k_query_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    expected = {tuple(r) for r in con.execute(queries.ORACLE_SQL["op7_exact_top_k"]).fetchall()}
    assert {tuple(r) for r in queries.QUERIES["op7_exact_top_k"](spark, sf).collect()} == expected
