"""Operators that compare texts, against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orbitframe.llm import fm_dedup, graph, jaccard_join, suffix_dedup, windows
from orbitframe.llm.windows import pack, unpack

from .conftest import ODD, WORDS


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(text):
    text = [*text, 0]
    assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=12), min_size=1, max_size=6))
def test_fm_index(parts):
    m = len(parts)
    text = np.array([x for i, p in enumerate(parts) for x in ([*(c + m for c in p), i])], np.int64)
    index = fm_dedup.FMIndex(text, m)
    for p in parts:
        for a in range(len(p)):
            low, high = np.array([0]), np.array([len(text)])
            for c in reversed(p[a : a + 3]):
                low, high = index.back(np.array([c + 1]), low, high)
            want = sum(q[i : i + len(p[a : a + 3])] == p[a : a + 3] for q in parts for i in range(len(q)))
            assert high[0] - low[0] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**62), 2**62), max_size=20), min_size=1, max_size=3), st.binary(max_size=30))
def test_columns_round_trip(lists, raw):
    arrays = [np.array(x, np.int64) for x in lists] + [np.frombuffer(raw, np.uint8)]
    for a, b in zip(arrays, unpack(pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()


def plain_dedup(rows, length, words):
    first, tokens = {}, []
    for i, t in rows:
        x = WORDS.findall(t or "") if words else (t or "").encode()
        tokens.append((i, x))
        if i is not None:
            for p in range(len(x) - length + 1):
                k = tuple(x[p : p + length]) if words else x[p : p + length]
                first[k] = min(i, first.get(k, i))
    out = []
    for i, x in tokens:
        gone = [False] * len(x)
        for p in range(len(x) - length + 1) if i is not None else ():
            if first[tuple(x[p : p + length]) if words else x[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        kept = [c for c, g in zip(x, gone, strict=True) if not g]
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(x), sum(gone), spans, hashlib.sha256(" ".join(kept).encode() if words else bytes(kept)).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 4)))
    passages = [" ".join(word() for _ in range(r.randint(8, 40))) for _ in range(6)]
    rows = []
    for i in range(70):
        parts = [" ".join(word() for _ in range(r.randint(0, 30))) for _ in range(3)]
        parts.insert(r.randint(0, 3), r.choice(passages))
        rows.append((r.randint(0, 90), r.choice([" ", "\n"]).join(parts)))
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(300 + i, passages[0]) for i in range(20)]  # crowded segments
    rows += [(400, "a" * 300), (401, "a" * 120), (402, "ab " * 80), (399, "b" + "a" * 60)]
    return rows + [(i, t) for i, t in ODD if len(t or "") < 1000]


@pytest.mark.parametrize("words", [False, True])
def test_common_grams_change_shards_but_not_results(table, words):
    module = fm_dedup if words else suffix_dedup
    rows = corpus(4)
    docs = windows.numbered(table(rows), "doc_id", "text").select("doc_id", "base", "text")
    cutter = windows.Cutter(module.LENGTH, module.GRAM, words, 4)
    ids, base, texts = np.arange(len(rows)), np.zeros(len(rows), np.int64), [(t or "").encode() for _, t in rows]
    cutter.cut(ids, base, texts)
    cutter.common = np.unique(cutter.last_grams)[::2]  # every other anchor is common: equal windows still get equal anchors
    columns = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string" if words else "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    forced, found = cutter.common, windows.common_grams
    try:
        windows.common_grams = lambda *_: forced
        got = windows.judged(docs, cutter, module.solve, module.finish, columns).collect()
    finally:
        windows.common_grams = found
    want = sorted(((i, n, g, h) for i, n, g, _, h in plain_dedup(rows, module.LENGTH, words)), key=repr)
    assert sorted(((r[0], r[1], r[2], r["kept_sha256"]) for r in got), key=repr) == want
    assert isinstance(windows.common_grams(docs, cutter), np.ndarray)


def test_shards_follow_counted_bytes(spark):
    assert windows.shard_count(spark.createDataFrame([("one row",)], "text string")) == windows.LEAST_SHARDS
    half = spark.range(1_000).selectExpr("repeat('ab', 10000) as text")
    both = half.crossJoin(half.select("text").limit(1).withColumnRenamed("text", "other")).select("text")
    assert windows.shard_count(half) == windows.shard_count(both) == max(windows.LEAST_SHARDS, 20_000_000 // windows.SHARD_BYTES)


@pytest.mark.parametrize(("module", "words"), [(suffix_dedup, False), (fm_dedup, True)])
def test_long_texts_hot_ids_and_dealing_in_two_steps(table, monkeypatch, module, words):
    """Texts of 200 KB that share passages, an id with a third of all rows, and more shards than a chunk is dealt to."""
    monkeypatch.setattr(windows, "FAN", 4)
    monkeypatch.setattr(windows, "REFLUSH", 30_000)
    monkeypatch.setattr(windows, "SHARD_BYTES", 10_000)
    monkeypatch.setattr(windows, "SALTS", 3)
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    shared = [" ".join(word() for _ in range(60)) for _ in range(5)]
    long = lambda: " ".join(x for _ in range(100) for x in (" ".join(word() for _ in range(380)), r.choice(shared) if r.random() < 0.3 else word()))
    rows = [(i, long()) for i in range(2)] + [(7, " ".join([word(), shared[i % 5], word()])) for i in range(40)] + [(i, r.choice(shared)) for i in range(20, 40)]
    rows += [(3, "ab " * 30_000), (4, "ab " * 30_000)] + corpus(3)[:60]
    cols = ("n_words" if words else "n_bytes", "n_removed", "kept_sha256")
    got = sorted(((x["doc_id"], *(x[c] for c in cols)) for x in module.dedup(table(rows)).collect()), key=repr)
    assert got == sorted(((i, n, g, h) for i, n, g, _, h in plain_dedup(rows, module.LENGTH, words)), key=repr)
    assert max(len(t or "") for _, t in rows) > 150_000


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("module", "words"), [(suffix_dedup, False), (fm_dedup, True)])
def test_window_dedup(table, monkeypatch, seed, module, words):
    monkeypatch.setattr(windows, "CHUNK", 700)  # texts meet across chunks, and crowded segments within them
    monkeypatch.setattr(windows, "FLUSH", 4_000)
    rows = corpus(seed)
    cols = ("n_words" if words else "n_bytes", "n_removed", "kept_sha256")
    got = sorted(((r["doc_id"], *(r[c] for c in cols)) for r in module.dedup(table(rows).repartition(3)).collect()), key=repr)
    want = sorted(((i, n, g, h) for i, n, g, _, h in plain_dedup(rows, module.LENGTH, words)), key=repr)
    assert got == want and sum(g for _, _, g, _ in want) > 500
    if not words:
        spans = Counter((r["doc_id"], r["n_spans"]) for r in module.dedup(table(rows)).collect())
        assert spans == Counter((i, s) for i, _, _, s, _ in plain_dedup(rows, module.LENGTH, words))
    assert module.dedup(table([])).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_links(rows):
    sets = []
    for i, t in rows:
        w = WORDS.findall(t or "")
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []), tuple(w)))
    n = len(rows)
    linked = defaultdict(set)
    for a in range(n):
        for b in range(a):
            (i, s, w), (j, t, v) = sets[a], sets[b]
            if i is not None and j is not None and (w == v or (s and t and 5 * len(s & t) >= 4 * len(s | t))):
                linked[a].add(b), linked[b].add(a)
    out = []
    for a in range(n):
        group, todo = {a}, [a]
        while todo:
            for b in linked[todo.pop()] - group:
                group.add(b), todo.append(b)
        out.append((sets[a][0], min((sets[b][0] for b in group if sets[b][0] is not None), default=None), len(linked[a])))
    return sorted(out, key=repr)


def near_copies(seed, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    bases = [[r.choice(words) for _ in range(r.randint(30, 90))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w)))
    return rows + [(100, "one two"), (101, "one\ttwo"), (102, "two one"), (103, "a b c d e"), (104, "a b c d e"), (105, "a b c d e f")] + [(i and i + 200, t) for i, t in ODD if len(t or "") < 1000]


@pytest.mark.parametrize("block", [1_000, 7])
def test_jaccard_join(table, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", block)  # groups within one task, and dealt out in blocks
    rows = near_copies(5)
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.classes(table(rows), recall=0.999999).collect()), key=repr)
    assert got == plain_links(rows)


def chained(n):
    """Texts in a long chain: each is linked with its next ones only."""
    words = [f"c{i}" for i in range(60 + 3 * n)]
    return [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(n)]


def test_long_chains_are_compared_bucket_by_bucket(table, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 5)
    seen, real = [], jaccard_join._scopes

    def spied(*args):
        seen.append(real(*args))
        return seen[-1]

    monkeypatch.setattr(jaccard_join, "_scopes", spied)
    rows = chained(400) + [(i and 1000 + i, t) for i, t in near_copies(7, 40)]
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.classes(table(rows), recall=0.9999999).collect()), key=repr)
    assert got == plain_links(rows)
    places = seen[0].select("place").distinct().collect()
    assert {0} < {r["place"] for r in places}  # the chain by buckets, small groups as a whole


def test_shipped_settings_against_brute_force(spark):
    """All documents of sf0.01 with the recall and rows that the query uses."""
    d = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.query(spark, d).collect()}
    sets = {}
    for i, t in rows:
        w = WORDS.findall(t or "")
        sets[i] = (frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []), tuple(w))
    by_gram = defaultdict(set)
    for i, (s, _) in sets.items():
        for g in s:
            by_gram[g].add(i)
    links = {i: {j for j in set().union(*(by_gram[g] for g in s)) - {i} if 5 * len(s & sets[j][0]) >= 4 * len(s | sets[j][0])} if s else {j for j, (x, _) in sets.items() if not x and j != i} for i, (s, _) in sets.items()}
    want = sum(map(len, links.values()))
    assert sum(n for _, n in got.values()) >= 0.999 * want > 100 and all(n <= len(links[i]) for i, (_, n) in got.items())
    assert sum(got[i][0] == got[j][0] for i in links for j in links[i]) >= 0.999 * want


def test_representatives(table):
    rows = near_copies(6)
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.representatives(table(rows)).collect()]
    assert {i for i, _ in kept if i is not None} == {c for i, c, _ in plain_links(rows) if i is not None}
    assert jaccard_join.classes(table([])).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_every_text_is_kept_or_linked_with_a_kept_one(table, seed):
    r = random.Random(seed)
    rows = [(r.randint(0, 25), t) for _, t in near_copies(seed, 50)] + [(5, "text a " * 9), (5, "words of b " * 9), (7, "words of b " * 9)]
    kept = Counter((x["doc_id"], x["text"]) for x in jaccard_join.representatives(table(rows)).collect())
    by_text = {}
    for i, t in rows:
        by_text.setdefault(tuple(WORDS.findall(t or "")), len(by_text))
    # Classes of texts, with each text's rows under an id of its own.
    of = {k: c for k, c, _ in plain_links([(k, " ".join(w)) for w, k in by_text.items()])}
    group = lambda t: of[by_text[tuple(WORDS.findall(t or ""))]]
    assert Counter(group(t) for _, t in kept.elements()) == Counter(set(map(group, (t for _, t in rows))))  # one row of each class
    least = {}
    for i, t in rows:
        least[group(t)] = min(i, least.get(group(t), i))
    assert all(least[group(t)] == i for i, t in kept)


def test_representatives_of_repeated_ids(table):
    plain = lambda i: " ".join(f"own{i}_{k}" for k in range(30))
    copied = " ".join(f"copied{k}" for k in range(30))
    rows = [(0, copied)] + [r for i in range(1, 21) for r in ((i, copied), (i, plain(i)), (i, plain(i)))]
    kept = sorted((r["doc_id"], r["text"]) for r in jaccard_join.representatives(table(rows)).collect())
    assert kept == [(0, copied)] + [(i, plain(i)) for i in range(1, 21)]


def test_bands_reach_their_recall():
    b = jaccard_join.bands_for(0.8, 0.999, 6)
    assert 1 - (1 - 0.8**6) ** b >= 0.999 > 1 - (1 - 0.8**6) ** (b - 1)
    rng = np.random.default_rng(1)
    m, hits = jaccard_join.MinHash(b, 6), 0
    for _ in range(60):
        common = rng.integers(0, 2**63, 160, np.uint64)
        x, y = (np.concatenate([common, rng.integers(0, 2**63, 20, np.uint64)]) for _ in range(2))
        s = m.bands_of(np.concatenate([x, y]), np.array([180, 180]))
        hits += bool((s[0] == s[1]).any())
    assert hits == 60
