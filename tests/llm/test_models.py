"""Classifiers: held-out accuracy on small made-up corpora, gradients, and edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from covarium.llm import langid, quality_model, toxicity
from covarium.llm.common import crc_fold

EDGE = [None, "", " \n ", "12 34 --", "a", "é", "word " * 500, "x" * 5000]


def corpora(spark, n=240, seed=1):
    """(docs, labels): four made-up languages; junk has label quality 0, a few words label toxic 1."""
    rng = random.Random(seed)
    sounds = {"aa": "ka ro mi ta su ne", "ab": "ka ro mi ta zu ve", "ba": "sch ung ein ver ich", "bb": "sch ung ein vor och"}
    docs, labels = [], []
    for i in range(n):
        lang = list(sounds)[i % 4]
        parts = sounds[lang].split()
        words = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 90))]
        toxic = int(rng.random() < 0.4)
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "moron", "lowei" + rng.choice(parts)])
        good = int(rng.random() < 0.6)
        if not good:
            words = [w + rng.choice(["###", "%%%"]) for w in words]
        docs.append((i, " ".join(words), lang if i % 10 else None, f"s{i % 3}", "extra"))
        labels.append((i, good, toxic, "extra"))
    docs += [(10_000 + i, t, None, None, None) for i, t in enumerate(EDGE)]
    labels += [(10_001, 1, 0, None), (10_004, None, None, None), (None, 1, 1, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, score string")


def test_quality_rules_from_trees(spark):
    docs, labels = corpora(spark)
    model = quality_model.train(docs, labels)
    scored = quality_model.score(docs, model).join(labels.select("doc_id", "quality"), "doc_id", "left").withColumn("held", crc_fold("doc_id", 3) == 1).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    held = [r for r in scored if r.held and r.quality is not None and r.doc_id < 10_000]
    assert np.mean([(r.score >= 0.5) == r.quality for r in held]) >= 0.95
    assert 0 < len(model.rules) <= 60
    x = np.array([quality_model.statistics((t or "").encode()) for t in EDGE])
    by_id = {r.doc_id: r.score for r in scored}
    assert [by_id[10_000 + i] for i in range(len(EDGE))] == pytest.approx(model.score(x).tolist())  # the compiled column equals the rules
    assert model.describe()


def test_quality_without_labels(spark):
    docs, labels = corpora(spark)
    none = quality_model.score(docs, quality_model.train(docs, labels.limit(0)))
    assert {round(r.score, 6) for r in none.collect()} == {0.5}
    one = quality_model.train(docs, labels.filter("quality = 1"))
    assert one.rules == [] and quality_model.score(docs.limit(0), one).count() == 0


def test_lasso_is_sparse_and_right():
    rng = np.random.default_rng(0)
    m = (rng.random((600, 20)) < 0.5).astype(float)
    y = (m[:, 3] > 0).astype(float)
    w, _ = quality_model.lasso(m, y, 0.02, np.zeros(20), 0.0)
    assert np.argmax(w) == 3 and (np.abs(w) > 1e-4).sum() <= 3


def test_language_hierarchy(spark):
    docs, _ = corpora(spark)
    model = langid.train(docs)
    assert model.langs == ["aa", "ab", "ba", "bb"] and sorted(map(sorted, model.groups)) == [[0, 1], [2, 3]]
    got = langid.predict(docs, model).withColumn("held", crc_fold("doc_id", 4) == 2).collect()
    assert all(0 <= r[-2] <= 1 for r in got)
    held = [r for r in got if r.held and r.lang]
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.95
    edge = {r.doc_id: r.lang_pred for r in got if r.doc_id >= 10_000}
    assert [edge[10_000 + i] for i in range(4)] == ["und"] * 4 and all(edge[10_000 + i] in model.langs for i in range(4, len(EDGE)))


def test_language_with_few_labels(spark):
    docs, _ = corpora(spark, 40)
    assert {r.lang_pred for r in langid.predict(docs, langid.train(docs.limit(0))).collect()} == {"und"}
    single = langid.train(docs.filter("lang = 'aa'"))
    assert {r.lang_pred for r in langid.predict(docs, single).collect()} == {"aa", "und"}


def test_a_language_is_learned_though_other_rows_repeat(spark):
    """A million copies of a few rows leave each language its own distinct rows."""
    rng = random.Random(8)
    words = {"xx": ["hausen", "strasse", "nicht", "werden", "schule"], "yy": ["casa", "calle", "noche", "ciudad", "escuela"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(["xx", "yy"] * 100)]
    few = spark.createDataFrame([(1000 + i, f"only a text {i}", "xx") for i in range(8)], "doc_id long, text string, lang string")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(few.crossJoin(spark.range(125_000)).drop("id"))
    got = {r.lang: r["count"] for r in langid.training_rows(docs).groupBy("lang").count().collect()}
    allowed = {lang: sum(1 for i, _, x in rows if x == lang and zlib.crc32(str(i).encode()) % 4 != 2) for lang in words}
    assert got["yy"] == allowed["yy"] and got["xx"] >= allowed["xx"]


def test_language_counts_of_long_texts_equal_short_pieces():
    t = b"ab cd " * 400_000
    b = np.frombuffer(b" " + b" ".join(t.split()) + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] << 8 | b[1:]
    three = two[:-1] << 8 | b[2:]
    want = sum(np.bincount((g * np.uint32(s)) >> np.uint32(20), minlength=langid.DIMS) for g, s in ((two, 0x9E3779B1), (three, 0x85EBCA6B)))
    assert langid.counts(t) == pytest.approx(want.astype(np.float32), rel=1e-5)


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(3)
    net = toxicity.Network(5, 3)
    net.p = {k: v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape) for k, v in net.p.items()}
    x, y, wt = rng.standard_normal((6, 4, 5)), np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 0.5, 1])
    mask = np.arange(6)[:, None] < np.array([6, 3, 1, 5])
    def loss():
        z = net.step(x, mask, y, wt)[2]
        return float((wt * (np.log1p(np.exp(z)) - y * z)).sum())
    g, dx, z = net.step(x, mask, y, wt)
    for k in ("W", "U", "b", "c", "v", "w", "o"):
        for i in [tuple(rng.integers(s) for s in net.p[k].shape) for _ in range(6)]:
            keep = net.p[k][i]
            net.p[k][i] = keep + 1e-4
            up = loss()
            net.p[k][i] = keep - 1e-4
            num = (up - loss()) / 2e-4
            net.p[k][i] = keep
            assert g[k][i] == pytest.approx(num, abs=2e-3, rel=2e-2), k
    for i in [(0, 0, 1), (2, 1, 3), (5, 0, 0), (5, 1, 2)]:
        keep = x[i]
        x[i] = keep + 1e-4
        up = loss()
        x[i] = keep - 1e-4
        num = (up - loss()) / 2e-4
        x[i] = keep
        assert dx[i] == pytest.approx(num, abs=2e-3, rel=2e-2)
    # the lean form gives the same logits
    words = x.reshape(24, 5).astype(np.float32)
    net.p = {k: v.astype(np.float32) for k, v in net.p.items()}
    lean = net.logits(words @ net.p["W"] + net.p["b"], np.arange(24).reshape(6, 4), mask)
    assert lean == pytest.approx(z, abs=1e-4)


def test_toxicity(spark):
    docs, labels = corpora(spark, 400)
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs.drop("score"), model).withColumn("held", crc_fold("doc_id", 3) == 1).join(labels.select("doc_id", "toxic"), "doc_id", "left").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held and r.toxic is not None and r.doc_id < 10_000]
    assert np.mean([(r.score >= 0.7) == r.toxic for r in held]) >= 0.9
    edge = {r.doc_id: r.score for r in got if r.doc_id >= 10_000}
    assert [edge[10_000 + i] for i in range(3)] == [0.0] * 3
    again = {r.doc_id: r.score for r in toxicity.score(docs.drop("score").repartition(5), model).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, abs=2e-5) for r in got)
    assert toxicity.score(docs.drop("score").limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs, labels = corpora(spark, 40)
    got = toxicity.score(docs.drop("score"), toxicity.train(docs, labels.filter("toxic = 0")))
    assert {r.score for r in got.collect()} == {0.0}


def test_windows_cover_all_words():
    docs = [np.arange(n) for n in (1, 23, 24, 25, 36, 37, 100)]
    who, start = toxicity.windows(docs)
    for i, d in enumerate(docs):
        seen = {w for s in start[who == i] for w in range(s, min(s + toxicity.WINDOW, len(d)))}
        assert seen == set(range(len(d)))


def test_queries_return_their_columns(spark):
    d = "/root/testdata/sf0.001"
    assert quality_model.query(spark, d).columns == ["doc_id", "held_out", "score", "predicted"]
    assert langid.query(spark, d).columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert toxicity.query(spark, d).columns == ["doc_id", "held_out", "score", "predicted"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    held = langid.query(spark, d).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL")
    assert held.filter(F.col("lang") == F.col("lang_pred")).count() >= 0.9 * held.count()
