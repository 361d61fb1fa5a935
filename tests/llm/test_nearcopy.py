"""The pipeline's near copies against a brute-force comparison of all pairs."""

import random

from pyspark.sql import functions as F

import corpus_pipeline


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 5 else {tuple(w)}


def slow_keep(rows):
    own = {i: sets(t) for i, t in rows}
    root = {i: i for i in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = 0
    for i in own:
        for j in own:
            if j < i and 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]):
                n += own[i] != own[j]
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in own if find(i) == i}, n


def test_all_pairs_of_four_fifths(spark):
    rng = random.Random(5)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows = []
    for _ in range(25):
        w = say(rng.randrange(12, 200))
        rows.append(" ".join(w))
        for rate in (0.01, 0.02, 0.03, 0.05):
            rows.append(" ".join(x if rng.random() > rate else f"W{rng.randrange(3000)}" for x in w))
        rows.append(" ".join(w + say(len(w) // rng.randrange(3, 7))))
    notice = " ".join(say(60))
    rows += [f"{' '.join(say(40))} {notice}" for _ in range(30)] + [None, "", "a b", "A  b", rows[0].upper()]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want, n = slow_keep(rows)
    assert n > 40
    got = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in got.collect()} == want


def test_parities_never_rule_a_similar_pair_out():
    import numpy as np

    from covarium.llm import nearcopy

    rng = np.random.default_rng(2)
    for n in (1, 5, 40, 400, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for k in (0, 1, max(1, n // 10), n // 5):
            b = np.unique(np.concatenate([a[k:], rng.integers(0, 1 << 63, k).astype(np.uint64)]))
            apart = int(np.bitwise_count((nearcopy.parities(a) ^ nearcopy.parities(b)).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(a, b))


def test_a_passage_in_many_texts_makes_no_pairs(spark, monkeypatch):
    """Texts that share half of their words are in one group for each shared shingle, but no pair of them leaves the join."""
    from covarium.llm import nearcopy

    rng = random.Random(6)
    part = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{part} " + " ".join(f"w{rng.randrange(9000)}" for _ in range(30))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert nearcopy.keep_first(df).count() == 200
    nodes = spark.createDataFrame([(nearcopy.node_of(x), len(x), [1], nearcopy.parities(x).tolist()) for x in (nearcopy.shingles(t.encode()) for _, t in rows)], "node long, n int, prefix array<long>, map array<long>")
    groups = nodes.select("node", "n", F.explode("prefix").alias("key"), F.col("node").alias("root"))
    monkeypatch.setattr(nearcopy, "_may", lambda c: c > 0)
    assert groups.count() == 200 and nearcopy._rest(groups, nodes).count() == 0


def bare_rows(texts):
    from types import SimpleNamespace

    import numpy as np

    from covarium.llm import nearcopy

    none = SimpleNamespace(value=(np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    node, n, _, prefix, maps = nearcopy._rows([t.encode() for t in texts], none)
    return [(a, b, c.tolist(), d.tolist()) for a, b, c, d in zip(node, n, prefix, maps, strict=True)]


NODES = "node long, n int, prefix array<long>, map array<long>"


def test_a_passage_in_many_long_texts_makes_no_pairs(spark, monkeypatch):
    """Sets far larger than 1024 bits are told apart too: texts of thousands of words that share half of them, or seven tenths, don't leave the join."""
    from covarium.llm import nearcopy

    rng = random.Random(7)
    say = lambda n: " ".join(f"w{rng.randrange(90000)}" for _ in range(n))
    monkeypatch.setattr(nearcopy, "_may", lambda c: c > 0)
    for size, share in ((3000, 0.5), (7000, 0.5), (5000, 0.7)):
        part = say(int(size * share))
        nodes = spark.createDataFrame(bare_rows([f"{part} {say(size - int(size * share) + 40 * i)}" for i in range(12)]), NODES)
        groups = nodes.select("node", "n", F.lit(1).alias("key"), F.col("node").alias("root"))
        assert nearcopy._rest(groups, nodes).count() == 0


def test_wide_parities_never_rule_a_similar_pair_out(spark):
    import numpy as np

    from covarium.llm import nearcopy

    rng = np.random.default_rng(3)
    rows = []
    for n in (1000, 1025, 1100, 2048, 2100, 9000, 17000, 30000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for gone, new in ((0, 0), (0, n // 5), (n // 5, 0), (n // 9, n // 9)):
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, new).astype(np.uint64)]))
            x, y = nearcopy.maps(a)[nearcopy.MAP_WORDS :], nearcopy.maps(b)[nearcopy.MAP_WORDS :]
            k = min(len(x), len(y))
            want = int(np.bitwise_count((nearcopy.parities(a, k) ^ nearcopy.parities(b, k)).view(np.uint64)).sum()) if k else 0
            assert want <= len(np.setxor1d(a, b))
            rows.append((x.tolist(), y.tolist(), want))
    assert {len(x) for x, _, _ in rows} == {0, 32, 64, 256} and any(len(x) != len(y) > 0 for x, y, _ in rows)
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, want int")
    assert df.filter(nearcopy._apart(F.col("x"), F.col("y")) != F.col("want")).count() == 0


def test_shingles_of_the_same_nodes_are_joined_as_one(spark):
    """A pair of near copies makes a row for each set of nodes that share a shingle with it, not for each shingle, and the number shared is that of all shingles."""
    from covarium.llm import nearcopy

    rng = random.Random(8)
    say = lambda n: [f"w{rng.randrange(90000)}" for _ in range(n)]
    words = say(2000)
    texts = [" ".join(words[:at] + say(3) + words[at + 3 :]) for at in (100, 700, 1900)]
    own = bare_rows(texts)
    nodes = spark.createDataFrame(own, NODES)
    shared = nodes.select("node", "n", F.explode("prefix").alias("key"))
    rows = nearcopy.folded(shared).withColumns({"root": F.col("node"), "most": F.lit(None).cast("long")})
    found = nearcopy._pairs(rows, nodes, "key").collect()
    assert 0 < len(found) <= 6  # of each pair, with the third text and without it
    count = {}
    for r in found:
        count[r.a, r.b] = count.get((r.a, r.b), 0) + r.w
    sets = {r[0]: set(r[2]) for r in own}
    assert len(count) == 3 and all(c == len(sets[a] & sets[b]) > 300 for (a, b), c in count.items())


def test_all_pairs_of_four_fifths_of_long_texts(spark):
    rng = random.Random(9)
    say = lambda n: [f"w{rng.randrange(90000)}" for _ in range(n)]
    rows = []
    for size in (900, 1020, 1900, 2050, 4200):
        for _ in range(3):
            w = say(size)
            rows.append(" ".join(w))
            for rate in (0.01, 0.02, 0.022, 0.024, 0.03):
                rows.append(" ".join(x if rng.random() > rate else f"W{rng.randrange(90000)}" for x in w))
            rows += [" ".join(w + say(size * k // 100)) for k in (20, 24, 25, 26)] + [" ".join(w[: size * 81 // 100])]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want, n = slow_keep(rows)
    assert n > 40 and len(want) > 30
    got = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in got.collect()} == want
