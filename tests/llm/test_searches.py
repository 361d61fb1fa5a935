"""Exact top-k, ranked lexical search and importance resampling against slow and plain versions, with nulls, ties, repeated rows, clashing columns and long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from covarium.llm import bisection, importance, inner_products, lexical, queries
from covarium.llm.terms import cut

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow_terms(t):
    return TERM.findall((t or "").translate(LOWER))


def test_terms_are_the_matches_of_the_pattern():
    for t in ("", "Añ ÑB-9_x\u0000y z[K]{q}~ÀÉ", "a'b`c^d@E", "日本 語 x", "".join(map(chr, range(700)))):
        assert [w.decode() for w in cut(t.encode())] == slow_terms(t)


# ---------------------------------------------------------------- top-k


def slow_top(rows, k, every=20):
    whole = {}
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for q in {(i, tuple(v)) for i, v in kept if i is not None and i % every == 0}:
        found = sorted((-sum(a * b for a, b in zip(q[1], v)), math.inf if i is None else i) for i, v in kept if i != q[0])
        whole[q] = found[:k]
        out.update((q[0], n, None if i == math.inf else i, -s) for n, (s, i) in enumerate(found[:k], 1))
    return out


def got_top(df, k):
    return Counter((r.query_id, r.rank, r.vec_id, r.score) for r in inner_products.search(df, F.col("id") % 20 == 0, k).collect())


@pytest.mark.parametrize("spread_of_lengths", [0.0, 2.0])
def test_top_k_equals_brute_force(spark, monkeypatch, spread_of_lengths):
    monkeypatch.setattr(inner_products, "SHARD", 70)
    monkeypatch.setattr(inner_products, "GROUP", 5)
    monkeypatch.setattr(inner_products, "HEAD", 30)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 12)) * np.exp(spread_of_lengths * rng.normal(size=(400, 1))) * np.linspace(2, 0.1, 12)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, base[7].tolist()) for i in range(40)]  # ties
    rows += [(None, base[9].tolist()), (None, base[0].tolist()), (20, rows[20][1]), (40, rows[41][1]), (2000, None), (2020, [1.0, None]), (2040, [math.nan] * 12), (2060, [math.inf] + [0.0] * 11), (2080, [5.0, -3.0]), (2100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(5)
    assert got_top(df, 7) == slow_top(rows, 7)


def test_top_k_of_few_and_of_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert got_top(spark.createDataFrame([], schema), 5) == Counter()
    assert got_top(spark.createDataFrame([(20, [1.0])], schema), 5) == Counter()
    rows = [(0, [1.0, 2.0]), (20, [-1.0, 0.5]), (3, [0.25, 0.0])]
    assert got_top(spark.createDataFrame(rows, schema), 5) == slow_top(rows, 5)


def test_bounds_cut_most_pairs_when_lengths_differ():
    """Long vectors come first; short ones are left out unseen, and partial sums rule out pairs of others. Whatever is cut, the result is the plain one."""
    rng = np.random.default_rng(5)
    v = np.floor(64 * rng.normal(size=(6000, 32)) * np.exp(1.5 * rng.normal(size=(6000, 1))) * np.linspace(3, 0.05, 32)).astype(np.int64)
    basis = np.linalg.svd(v.astype(float), full_matrices=False)[2].T
    order = np.argsort(-(v * v).sum(axis=1))
    q = inner_products.Side(np.arange(50), v[:50], basis)
    seen, scored = [], []
    real, exact = inner_products.survivors, inner_products.exact
    try:
        inner_products.survivors = lambda a, c, floor: seen.append(len(a.ids) * len(c.ids)) or real(a, c, floor)
        inner_products.exact = lambda a, c, *ij: (lambda s: scored.append(s.size) or s)(exact(a, c, *ij))
        best = inner_products.against(q, inner_products.in_blocks(order, v[order], basis, 128), 10, np.full(50, inner_products.LOWEST))
    finally:
        inner_products.survivors, inner_products.exact = real, exact
    assert sum(seen) < 0.6 * 50 * 6000 and sum(scored) < 0.5 * sum(seen)
    for i in range(50):
        s = v @ v[i]
        want = [j for j in np.lexsort((np.arange(6000), -s)) if j != i][:10]
        assert best.id[best.q == i].tolist() == want


# ---------------------------------------------------------------- lexical search


def slow_search(docs, items, k=20):
    cuts = [(i, t, slow_terms(t)) for i, t in docs]
    cuts = [c for c in cuts if c[2]]
    n_docs, total = len(cuts), sum(len(c[2]) for c in cuts)
    df = Counter(w for c in cuts for w in set(c[2]))
    out = Counter()
    for item, text in set(items):
        found = []
        for i, t, words in cuts:
            tf, m = Counter(words), 75 + (25 * len(words) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 12 * m)) for w in slow_terms(text) if tf[w])
            if s > 0:
                found.append((-s, math.inf if i is None else i))
        out.update((item, n, None if i == math.inf else i, -s) for n, (s, i) in enumerate(sorted(found)[:k], 1))
    return out


def got_search(docs, items, **k):
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in lexical.search(docs, items, **k).collect())


def prose(rng, n, first=0, words=60):
    return " ".join(f"w{first + min(rng.randrange(words), rng.randrange(words))}" for _ in range(n))


@pytest.mark.parametrize("terms", [200_000, 40])
def test_search_equals_brute_force(spark, monkeypatch, terms):
    monkeypatch.setattr(lexical, "SHARD_ROWS", 7)
    monkeypatch.setattr(lexical, "TERMS", terms)
    monkeypatch.setattr(lexical, "TOGETHER", 3)
    monkeypatch.setattr(lexical, "FIRST", 2)
    rng = random.Random(4)
    docs = [(i, prose(rng, rng.randrange(1, 40), 50 * (i % 3))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(30)] + [(None, docs[5][1]), (None, None), (7, None), (8, ""), (9, "--- !"), (3, docs[3][1]), (3, docs[4][1]), (400, prose(rng, 30_000, 0, 180))]
    items = [(i, prose(rng, rng.randrange(1, 12), 50 * (i % 3))) for i in range(12)] + [(0, None), (50, "zzz unknown"), (51, "W1 w1 W2"), (51, "w3"), (None, "w4 w5"), (50, "zzz unknown")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit(1)).repartition(4)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    assert got_search(d, q, k=6) == slow_search(docs, items, 6)


def test_search_of_empty_tables(spark):
    d, q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    one = spark.createDataFrame([(5, "a c")], "doc_id long, text string")
    assert got_search(d, q) == Counter() and got_search(one, q.limit(0)) == Counter()
    assert got_search(one, q) == slow_search([(5, "a c")], [(1, "a b")])


def test_bisection_parts_topics_and_orders_every_document():
    rng = np.random.default_rng(2)
    topic = rng.permutation(np.arange(400) % 4)  # halves are equal, so topics of one size can be parted
    docs = [np.unique(rng.integers(0, 60, 30) + 60 * t) for t in topic]
    start, flat = np.cumsum([0, *map(len, docs)]), np.concatenate(docs)
    tree = bisection.fit(start, flat, 3)
    leaf = tree.leaves(start, flat)
    assert leaf.min() >= 0 and leaf.max() < 8
    for x in np.unique(leaf):  # a leaf's documents are of one topic
        own = np.bincount(topic[leaf == x], minlength=4)
        assert own.max() >= 0.95 * own.sum()
    assert tree.leaves(np.array([0, 0]), np.zeros(0, np.int64)).shape == (1,)


# ---------------------------------------------------------------- importance resampling


def slow_resample(docs, target, n=1, buckets=10_000, share=10, least=20, seed=2024):
    def feats(t):
        w = slow_terms(t)
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    cuts = [(i, x, *feats(x)) for i, x in docs]
    for c in cuts:
        s.update(c[3])
    for x in target:
        t.update(feats(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * float(total_s + buckets) / ((s[b] + 1.0) * float(total_t + buckets))))
    rows = []
    for i, x, w, f in cuts:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((-r[3], math.inf if r[0] is None else r[0]) for r in rows if r[4] >= least)
    k = share * len(able) // 100
    drawn = [(math.nan if i == math.inf else i, -s_, n_) for n_, (s_, i) in enumerate(able[:k], 1)]
    return Counter(r[:4] for r in rows), sorted((s_, n_, str(i)) for i, s_, n_ in drawn)


@pytest.mark.parametrize("n, cell", [(1, 20), (2, 1)])
def test_resampling_equals_brute_force(spark, monkeypatch, n, cell):
    monkeypatch.setattr(importance, "ID_RANGE", cell)
    rng = random.Random(n)
    docs = [(i, prose(rng, rng.randrange(5, 60), 30 * (i % 4))) for i in range(300)]
    docs += [(i, docs[i][1]) for i in range(0, 40)] * 2 + [(None, docs[2][1]), (None, docs[2][1]), (None, docs[3][1]), (500, None), (501, ""), (502, "été ÉTÉ " * 20_000)]
    target = [prose(rng, 40, 0) for _ in range(20)] + [None, ""]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"rank": F.lit("r"), "WEIGHT": F.lit(1), "n_words": F.lit("q")}).repartition(5)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.resample(d, t, n=n, share=40).collect()
    rows, drawn = slow_resample(docs, target, n, share=40)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == rows
    have = sorted((r.score, r.rank, "nan" if r.doc_id is None else str(r.doc_id)) for r in got if r.rank is not None)
    assert have == drawn and [r[1] for r in sorted(have, key=lambda x: x[1])] == list(range(1, len(drawn) + 1))


def test_resampling_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a " * 30), (2, "b " * 30)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, docs).count() == 0
    assert importance.resample(docs, none, share=50).filter("rank = 1").count() == 1
    assert importance.resample(docs, docs, share=100, keep_text=True).filter("rank is not null").select("text").count() == 2


# ---------------------------------------------------------------- the queries and their SQL


@pytest.mark.parametrize("name, keys", [("op11_top_k", ("query_id", "rank")), ("op12_lexical_search", ("item_id", "rank")), ("op13_importance_resampling", ("doc_id",))])
def test_queries_equal_their_sql(spark, name, keys):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    rows = sorted(want.fetchall(), key=repr)
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == rows and rows
    assert len({tuple(r[columns.index(k)] for k in keys) for r in rows}) == len(rows)
