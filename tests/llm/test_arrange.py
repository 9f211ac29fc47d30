"""Fill-in-middle, conversation tries and the Jaccard join against brute force and SQL."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import conversation_trie, fim, jaccard, queries, signature_tree


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_conversation_trie", "op13_jaccard_join"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    found, wanted = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    assert in_order(tuple(r) for r in found.select(*columns).collect()) == in_order(wanted.select(*columns).fetchall())


# fill in the middle


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    n, h = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def pieces_of(rng, n):
    return "".join(rng.choice(["ab", "P", "<", ">", "<S", "M>", "é", "😀", " ", "\n", "\x00", "12", "zZ", "x" * 70, "-" * 70]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    rows = [(k, pieces_of(rng, rng.randint(0, 60))) for k in range(300)]
    rows += [(400, None), (401, ""), (None, "no id at all, is there"), (None, None), (402, "<P>"), (403, "a<M>b"), (404, "<PP>"), (405, "<<S>"), (406, "x" * 5000), (407, "é" * 700)]
    twins = pieces_of(rng, 300).replace(">", "")
    return rows + [(500 + k // 2, twins) for k in range(12)] + [(-1, twins), (600, pieces_of(rng, 9000))]


@pytest.mark.parametrize("piece", [7, 64, 1000, 1 << 20])
def test_fill_in_middle_equals_brute_force(spark, texts, piece):
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in texts], "doc_id long, text string, n int, output string")
    found = fim.fill_in_middle(docs, piece).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert in_order(tuple(r)[:6] for r in found) == in_order(brute_fim(*r) for r in texts)
    assert sorted(r.back for r in found) == sorted(t or "" for _, t in texts)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_an_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_functions_compose_in_any_grouping():
    """A text's function does not depend on how it is cut into blocks, characters included."""
    rng = random.Random(4)
    data = pieces_of(rng, 400).encode()
    whole = fim.Scan([data]).levels[-1]
    for cut in (1, 63, 64, 65, 500, len(data) - 1):
        left, right = (fim.Scan([x]).levels[-1] for x in (data[:cut], data[cut:]))
        for s in range(fim.STATES):
            middle = left[1][0][s]
            assert (right[1][0][middle], left[2][0][s] + right[2][0][middle]) == (whole[1][0][s], whole[2][0][s])


def test_units_are_found_from_every_state():
    rng = random.Random(5)
    data = pieces_of(rng, 200).encode()
    scan = fim.Scan([b"other", data])
    for s in range(fim.STATES):
        state, begins = s, []
        for k, byte in enumerate(data):
            state, one = fim.step(int(state), int(fim.CLASSES[byte]))
            begins += [k] * one
        ends = scan.ends(s)
        assert (ends[0][1], ends[1][1]) == (state, len(begins))
        assert scan.find(np.ones(len(begins), np.int64), np.arange(len(begins)), np.full(len(begins), s)).tolist() == begins


# conversation tries


def brute_trie(rows, every=5, most=8):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        rebuilt[c] = [*own.get(c - c % every, [])[:h], *ts[h:]] if every else ts
    members = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for path, convs in members.items():
        below = {p: m for p, m in members.items() if p[: len(path)] == path}
        inner = {p[:-1] for p in members if p}
        ends = sorted(c for c in convs if len(rebuilt[c]) == len(path))
        saved = sum((len(m) - 1) * len(p[-1][1].encode()) for p, m in below.items() if p)
        parent = min(members[path[:-1]]) if path else None
        row = (min(convs), len(path), parent, len(convs), sum(len(p) == len(path) + 1 for p in below), sum(p not in inner for p in below), saved)
        out.append((*row, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(6)
    rows = []
    for c in [*rng.sample(range(60), 45), 100, 101, 104, 203, 70_000, 140_001]:
        start = rng.choice(["hi", "hello é", ""])
        rows += [(c, None if t == 0 and rng.random() < 0.3 else t, rng.choice(["user", "bot"]) if t > 3 else "user", start if t == 0 else rng.choice(["a", "bb", None, "x" * 9])) for t in range(rng.choice([1, 2, 3, 8, 12, 15]))]
    for c in (300, 301, 302, 304, 309):
        rows += [(c, t, "user" if t % 2 else None, "same") for t in range(40)]
    rows += [(400, 1, "user", "tie"), (400, 1, "bot", "tie"), (400, 1, "user", "tie"), (400, 1, "user", "later"), (402, None, None, None), (402, None, "u", None), (None, 1, "user", "nobody"), (500, 0, "ab", "c"), (505, 0, "a", "bc")]
    rng.shuffle(rows)
    return rows


def trie_of(spark, rows, function, n=4):
    frame = spark.createDataFrame([(*r, 1, b"k") for r in rows], "conv_id long, turn long, role string, text string, depth int, key binary").repartition(n)
    return in_order(tuple(r) for r in function(frame).collect())


def test_trie_equals_brute_force(spark, conversations):
    assert trie_of(spark, conversations, conversation_trie.shared_prefix_trie) == in_order(brute_trie(conversations))
    assert trie_of(spark, conversations, conversation_trie.prefix_trie) == in_order(brute_trie(conversations, 0))


def test_trie_of_a_conversation_over_many_partitions(spark):
    """A conversation of a third of all rows, and equal rows, are sorted over several tasks."""
    rng = random.Random(8)
    rows = [(5, k, "user", f"turn {k % 7}") for k in range(400)] + [(7, k, "user", f"turn {k % 7}") for k in range(390)] + [(10, 3, "u", "again")] * 200
    rows += [(c, k, "user", rng.choice("ab")) for c in range(11, 40) for k in range(5)]
    assert trie_of(spark, rows, conversation_trie.shared_prefix_trie, 8) == in_order(brute_trie(rows))


def test_carried_rows_join_partitions():
    whole = [conversation_trie.turn_hash("u", str(k)) for k in range(9)]

    def key(xs):
        value = 0
        for x in xs:
            value = (value * conversation_trie.BASE + x) % conversation_trie.PRIME
        return value

    ends = [(0, 1, (4, 2, conversation_trie.packed(key(whole[:2])), 20)), (2, 4, (4, 3, conversation_trie.packed(key(whole[2:5])), 30)), (3, 4, (6, 1, conversation_trie.packed(key(whole[8:])), 5)), (4, 7, (7, 1, conversation_trie.packed(1), 1))]
    assert conversation_trie.carried(ends) == {2: (4, 2, key(whole[:2]), 20), 3: (4, 5, key(whole[:5]), 50)}


def test_trie_of_no_turns(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.shared_prefix_trie(frame).count() == 0


# Jaccard join


def brute_classes(rows, words=5, percent=80):
    sets = []
    for _, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append({b" ".join(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {b" ".join(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    return [(rows[k][0], len(sets[k]), least[group[k]]) for k in range(len(rows))]


def classes_of(spark, rows, **limits):
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, n string, id int").repartition(3)
    return in_order(tuple(r) for r in jaccard.similar_classes(docs, **limits).collect())


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def similar_texts():
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(3000)]
    passages = [rng.choices(vocabulary, k=rng.randint(20, 60)) for _ in range(4)]
    rows = []
    for size, copies, most in ((60, 20, 3), (200, 70, 9), (130, 40, 5), (12, 8, 1), (900, 6, 30)):
        first = rng.choices(vocabulary, k=size) + rng.choice(passages)
        rows += [" ".join(edited(rng, first[: len(first) - rng.randint(0, size // 8)], rng.randint(0, most))) for _ in range(copies)]
    rows += [" ".join(rng.choices(vocabulary, k=rng.randint(3, 120)) + rng.choice(passages)) for _ in range(60)]
    rows += ["one two", "One  TWO\n", "one", None, "", " \t\n", "É x y z", "é x y z", rows[0].upper(), rows[0], rows[0].replace(" ", "\u00a0", 1)] + ["a b c d e"] * 5 + [" ".join(["again"] * 5000)] * 2
    numbered = [(k, t) for k, t in enumerate(rows)]
    rng.shuffle(numbered)
    return [*numbered, (None, rows[0]), (None, "nobody has this text at all"), (None, None), (7, rows[7]), (7, "another text of the same id")]


@pytest.mark.parametrize(("most", "percent"), [(128, 80), (2, 80), (5, 60)])
def test_classes_equal_brute_force(spark, similar_texts, most, percent):
    found = classes_of(spark, similar_texts, most=most, percent=percent)
    wanted = brute_classes(similar_texts, percent=percent)
    assert found == in_order(wanted)
    assert len({w[2] for w in wanted}) < len(similar_texts) - 60


def test_classes_of_split_clusters(spark, similar_texts, monkeypatch):
    monkeypatch.setattr(jaccard, "SPREAD_SETS", 5)
    assert classes_of(spark, similar_texts) == in_order(brute_classes(similar_texts))


def test_classes_of_no_documents(spark):
    assert jaccard.similar_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def some_sets(rng, count, universe):
    base = [np.unique(rng.integers(0, 2**64, rng.integers(5, 900), np.uint64)) for _ in range(count // 4)]
    out = []
    for _ in range(count):
        own = base[rng.integers(len(base))]
        kept = own[rng.random(len(own)) < rng.choice([0.85, 0.93, 0.99])]
        out.append(np.unique(np.concatenate([kept, rng.choice(universe, rng.integers(0, 30))])))
    return [s for s in out if len(s)]


def classes(links, n):
    group = list(range(n))
    for u, v in links:
        group = [group[u] if g == group[v] else g for g in group]
    return group


@pytest.mark.parametrize("leaf", [32, 3])
def test_buckets_lose_no_link(monkeypatch, leaf):
    """Whatever is similar is connected by the links of some bucket; the links of one cell are those of all pairs."""
    for module in (jaccard, signature_tree):
        monkeypatch.setattr(module, "LEAF", leaf)
    rng = np.random.default_rng(10)
    universe = rng.integers(0, 2**64, 200, np.uint64)
    sets, frequent = some_sets(rng, 240, universe), np.sort(universe[:50])
    firsts = [jaccard.prefix(s, jaccard.prefix_size(len(s), 80), frequent)[0] for s in sets]
    shown = [jaccard.prefix(s, jaccard.SHOWN * len(f), frequent) for s, f in zip(sets, firsts, strict=True)]
    seen = signature_tree.Sets(np.array([len(s) for s in sets]), np.array([x[1] for x in shown]), [signature_tree.bitmap(x[0]) for x in shown])
    links = jaccard.bucket_links(np.concatenate(firsts).view(np.int64), np.repeat(np.arange(len(sets)), [len(f) for f in firsts]), seen, 80)
    group = classes(links, len(sets))
    true = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - k)]
    assert len(true) > 100 and all(group[i] == group[j] for i, j in true)
    order = np.argsort([len(s) for s in sets], kind="stable")
    links = jaccard.cell_links(np.zeros(len(sets), int), order.tolist(), [sets[k] for k in order], 80, False)
    assert {tuple(sorted(x)) for x in links} <= {tuple(sorted(x)) for x in true} and len(links) == len(sets) - len(set(classes(true, len(sets))))


def test_tree_leaves_out_most_pairs():
    """Of sets that share a passage alone, hardly a pair is held against the sets."""
    rng = np.random.default_rng(11)
    passage = rng.integers(0, 2**64, 40, np.uint64)
    sets = sorted((np.unique(np.concatenate([passage, rng.integers(0, 2**64, rng.integers(100, 800), np.uint64)])) for _ in range(600)), key=len)
    tree = signature_tree.SignatureTree(signature_tree.Sets(np.array([len(s) for s in sets]), np.full(len(sets), jaccard.WHOLE), [signature_tree.bitmap(s) for s in sets]))
    held = []
    assert not list(tree.links(80, lambda x, y: bool(held.append((x, y)))))
    assert len(held) < 20


def test_runs_come_whole_or_as_large(monkeypatch):
    monkeypatch.setattr(jaccard, "TREE", 5)
    rng = np.random.default_rng(12)
    sizes = {1: 3, 2: 40, 3: 1, 4: 12, 5: 2, 7: 10, 9: 60, 11: 2}
    tokens = np.repeat(list(sizes), list(sizes.values()))
    cuts = [0, *np.sort(rng.integers(0, len(tokens), 25)).tolist(), len(tokens)]
    batches = [pa.RecordBatch.from_arrays([pa.array(tokens[a:b]), pa.array(np.arange(a, b))], ["token", "id"]) for a, b in zip(cuts, cuts[1:], strict=False)]
    seen, large = [], set()
    for t, i, is_large in jaccard.whole_runs(iter(batches), 8):
        assert not is_large or len(set(t.tolist())) == 1
        assert is_large or not large & set(t.tolist()) and all(sizes[x] == (t == x).sum() for x in set(t.tolist()))
        large |= set(t.tolist()) if is_large else set()
        seen += i.tolist()
    assert seen == list(range(len(tokens))) and {2, 9} <= large
