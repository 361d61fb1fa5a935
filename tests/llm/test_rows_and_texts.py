"""Rows that repeat ids or have none, columns with clashing names, and very long texts, for every operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import prose, slow_rules, slow_tree

from covarium.llm import bpe, langid, merkle, mixing, nearcopy, quality_model, rules, simhash, substring, toxicity, wordpiece
from covarium.llm.common import LAST_ID, WordCache, slices


def slow_removed(rows, window):
    """n_removed of every row by its own words; ids tell documents apart, a null id comes last."""
    key = lambda i: LAST_ID if i is None else i
    first = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, LAST_ID), key(i))
    out = []
    for i, t in rows:
        w = (t or "").split()
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < key(i) for j in range(window)}
        out.append((i, t, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [6, 50])
def test_substring_rows_with_repeated_and_null_ids(spark, window):
    rng = random.Random(window)
    shared = [prose(rng, 3 * window, 900) for _ in range(4)]
    rows = [(2, prose(rng, 160, 900) + " " + shared[0]), (2, "ten words are too few to repeat anything at all"), (2, prose(rng, 80, 900)), (1, shared[0]), (None, shared[0]), (None, shared[1]), (None, shared[1] + " tail"), (LAST_ID - 1, shared[1])]
    for _ in range(60):
        s = rng.choice(shared).split()
        rows.append((rng.choice([None, 1, 2, 3, 4, 5]), f"{prose(rng, rng.randrange(window), 900)} {' '.join(s[rng.randrange(5) : len(s) - rng.randrange(5)])} {prose(rng, 4, 900)}"))
    rows += rows[:9]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in substring.remove(df, window).select("doc_id", "text", "n_words", "n_removed", "kept").collect()]
    assert sorted(got, key=repr) == slow_removed(rows, window)


def test_substring_levels():
    assert substring.lengths(50) == [13, 25] and substring.lengths(10) == [5] and substring.lengths(100) == [13, 25, 50]
    rng = np.random.default_rng(1)
    a = rng.integers(0, 50, 400).astype(np.uint64)
    for span in (1, 2, 3, 7, 38):
        assert substring.sliding_min(a, span).tolist() == [min(a[k : k + span]) for k in range(len(a) - span + 1)]
    # every start lies in one run, and its anchor is the smallest hash inside its window
    short = substring.Rolling(a, substring.BASES[0]).all(13)
    pick, lo, hi = substring.runs(a, 50, 13, None, None)
    assert lo[0] == 0 and hi[-1] == 350 and (lo[1:] == hi[:-1] + 1).all()
    for p, x, y in zip(pick, lo, hi, strict=True):
        assert all(short[s : s + 38].min() == p for s in range(x, y + 1))
    part = substring.runs(a, 50, 13, [5, 200], [20, 201])
    assert sorted(s for x, y in zip(part[1], part[2], strict=True) for s in range(x, y + 1)) == [*range(5, 21), 200, 201]


def test_only_repeated_windows_are_extended(spark, monkeypatch):
    """The second level sees the texts whose short anchors repeat, and no others."""
    seen = []
    real = substring.append
    monkeypatch.setattr(substring, "append", lambda df, inputs, fn, *a, **k: seen.append((fn.__name__, df)) or real(df, inputs, fn, *a, **k))
    rng = random.Random(3)
    part = prose(rng, 60, 5000)
    rows = [(1, f"{prose(rng, 90, 5000)} {part}"), (2, f"{part} {prose(rng, 70, 5000)}"), (3, prose(rng, 300, 5000))]
    assert substring.windows(spark.createDataFrame(rows, "doc_id long, text string")).filter("late").select("kid").distinct().count() == 1
    names = [n for n, _ in seen]
    assert names[:2] == ["_anchor_rows", "_cell_rows"]
    assert {r.kid for r in seen[1][1].select("kid").collect()} == {1, 2}


def test_near_copies_lose_no_other_row(spark):
    rng = random.Random(4)
    a, b, c = (prose(rng, 60, 900) for _ in range(3))
    rows = [(None, a, "x"), (None, b, "y"), (7, b + " end", "z"), (7, c, "p"), (7, c, "q"), (7, "quite another text about something else", "r"), (9, a.upper(), "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _kid string")
    want = {(9, a.upper()), (7, b + " end"), (7, c), (7, "quite another text about something else")}
    got = [tuple(r) for r in nearcopy.keep_first(df).collect()]
    assert len(got) == 4 and {r[:2] for r in got} == want
    assert sorted(got) == sorted(tuple(r) for r in nearcopy.keep_first(df.repartition(7)).collect())
    assert nearcopy.keep_first(df.limit(0)).count() == 0


def test_one_large_component_is_named_alike(spark):
    rows = [(i, f"text number {i % 40}") for i in range(400)] + [(None, "text number 3"), (None, "only without an id")]
    got = simhash.cluster(spark.createDataFrame(rows, "doc_id long, text string"))
    by = {}
    for r in got.collect():
        by.setdefault(r.fp, set()).add(r.component_id)
    assert got.count() == len(rows) and all(len(v) == 1 for v in by.values())
    assert len([r for r in got.collect() if r.component_id is None]) == 1


def test_mixing_without_ids_meets_its_target(spark):
    rng = random.Random(5)
    rows = [(None, prose(rng, rng.randrange(5, 40), 900), rng.choice("ab")) for _ in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    _, sources = mixing.plan(df)
    goal = {r.name: r.target for r in sources.collect()}
    got = dict.fromkeys(goal, 0)
    for r in mixing.mix(df).collect():
        got[r.source] += len(r.text.split())
    assert all(abs(got[s] - goal[s]) <= 40 for s in goal), (got, goal)


CLASH = "doc_id long, text string, N_words int, n_tokens string, n_unknown string, ids string, decoded int, score string, lang_pred int, kept double, n_removed string, failed string, log_words string, fp string"


def test_added_columns_replace_those_of_the_same_name(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 70, 30), 5, "a", "b", "c", 1, "d", 2, 1.0, "e", "f", "g", "h") for i in range(6)]
    df = spark.createDataFrame(rows, CLASH)
    net = toxicity.fit([b"good text here", b"bad idiot text"] * 20, np.array([0.0, 1.0] * 20), 1, 1)
    lang = langid.Hierarchy(["xx"], [[0]], np.zeros((langid.DIMS + 1, 1), np.float32), [], np.zeros((langid.DIMS + 1, 0), np.float32))
    made = {
        "bpe": (bpe.encode(df), {"ids"}), "round": (bpe.round_trip(df), {"ids", "decoded"}), "pieces": (wordpiece.count_tokens(df), {"n_words", "n_tokens", "n_unknown"}),
        "lang": (langid.predict(df, lang), {"lang_pred", "score"}), "tox": (toxicity.score(df, net), {"score"}), "substring": (substring.remove(df, 6), {"n_words", "n_removed", "kept"}),
        "stats": (quality_model.with_statistics(df), set(quality_model.STATS)), "simhash": (simhash.fingerprints(df), {"fp"}),
    }
    for name, (out, new) in made.items():
        cols = [c.lower() for c in out.columns]
        assert len(cols) == len(set(cols)) and set(cols) == {c.lower() for c in df.columns} | new, name
        assert out.select(*new).count() == 6, name
    assert wordpiece.count_tokens(df).select("n_words").first()[0] == 70
    for fn in (rules.filter_documents, mixing_of, substring.clean_documents, nearcopy.keep_first):
        assert fn(df).columns == df.columns
    assert rules.ledger(df).count() == merkle.fingerprints(df).count() == simhash.cluster(df).count() == 6


def mixing_of(df):
    return mixing.mix(df.withColumn("source", F.lit("s"))).drop("source")


def test_settings_of_the_session_stay(spark):
    before = {k: spark.conf.get(f"spark.sql.execution.arrow.{k}") for k in ("maxRecordsPerBatch", "maxBytesPerBatch")}
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert wordpiece.count_tokens(df).count() == 1
    assert before == {k: spark.conf.get(f"spark.sql.execution.arrow.{k}") for k in before}


def test_batches_are_worked_off_in_slices():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in [10, 5 << 20, 3, 3 << 20, 2 << 20, 7]]), pa.array(range(6))], ["t", "i"])
    parts = list(slices(b, [0]))
    assert [p.num_rows for p in parts] == [1, 1, 2, 2] and sum((p.column(1).to_pylist() for p in parts), []) == list(range(6))
    many = pa.RecordBatch.from_arrays([pa.array(["x"] * 2500)], ["t"])
    assert [p.num_rows for p in slices(many, [0])] == [1000, 1000, 500]


def test_word_caches_hold_short_words_only():
    c = WordCache(len)
    assert c["a" * 1000] == 1000 and not dict(c) and c["abc"] == 3 and dict(c) == {"abc": 3}
    for i in range(WordCache.ENTRIES + 5):
        c[f"w{i}"]
    assert len(c) <= WordCache.ENTRIES


# ---------------------------------------------------------------- very long texts


@pytest.fixture(scope="module")
def long_rows(spark):
    """One text of a million words among short ones; it repeats a passage of a short one, and a copy of it with other letters follows."""
    rng = random.Random(8)
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(1_000_000)]
    passage = " ".join(f"p{i}" for i in range(60))
    big = " ".join(words[:700_000]) + ".\n\n" + passage + " " + " ".join(words[700_000:])
    return [(1, passage), (2, big), (3, big.upper().replace("P", "p")), (4, "a short one"), (5, "z" * 200_000)]


@pytest.fixture(scope="module")
def long_docs(spark, long_rows):
    return spark.createDataFrame(long_rows, "doc_id long, text string").repartition(3)


def test_long_texts_pass_through_every_operator(spark, long_docs, long_rows):
    text = dict(long_rows)
    counts = {r.doc_id: r for r in wordpiece.count_tokens(long_docs).select("doc_id", "n_words", "n_tokens").collect()}
    assert counts[2].n_words == 1_000_060 and counts[5].n_words == 1 and counts[5].n_tokens > 20_000
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove(long_docs).select("doc_id", "n_words", "n_removed").collect()}
    assert got[1] == (60, 0) and got[2] == (1_000_060, 60) and got[3][0] == 1_000_060 and got[5] == (1, 0)
    fps = {r.doc_id: r for r in simhash.cluster(long_docs).collect()}
    assert fps[2].fp == fps[3].fp and fps[3].component_id == 2 and fps[4].component_id == 4
    assert {r.doc_id for r in nearcopy.keep_first(long_docs).select("doc_id").collect()} == {1, 2, 4, 5}
    book = {r.doc_id: r for r in rules.ledger(long_docs).collect()}
    assert (book[1].n_words, book[1].n_repeat_words) == slow_rules(text[1])[::5] and book[2].n_words == 1_000_060
    both = bpe.round_trip(long_docs).select("doc_id", F.size("ids").alias("n"), (F.col("decoded") == F.col("text")).alias("same")).collect()
    assert all(r.same and r.n for r in both)
    tree = {r.doc_id: r for r in merkle.fingerprints(long_docs).select("doc_id", "n_chars", "fingerprint").collect()}
    assert tree[2].n_chars == len(text[2]) and tree[2].fingerprint == slow_tree(text[2])[0]
    stats = {r.doc_id: r for r in quality_model.with_statistics(long_docs).select("doc_id", "log_words").collect()}
    assert stats[2].log_words == pytest.approx(np.log1p(1_000_060))


def test_long_toxic_texts_are_found(spark):
    """All toxic training texts are long, and toxic in one passage: they are learned from, and long held-out ones are found."""
    rng = random.Random(9)
    say = lambda n: [f"{rng.choice('bdfgklm')}{rng.choice('aeiou')}{rng.randrange(300)}" for _ in range(n)]
    docs, labels = [], []
    for i in range(90):
        w = say(4000 if i % 3 == 0 else 60)
        if i % 3 == 0:
            at = rng.randrange(len(w) - 40)
            for k in range(0, 30, 3):
                w[at + k] = rng.choice(["idiot", "moron", "scum"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    d, la = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert min(len(t) for i, t in docs if i % 3 == 0) > 12_000
    model = toxicity.train(d, la)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    assert np.mean([(got[i] >= toxicity.THRESHOLD) == y for i, y in labels]) >= 0.9
    cut = spark.createDataFrame([("ab" * 50_000,)], "t string").select(F.length(toxicity.passages(F.col("t"), 12_000)).alias("n")).first()[0]
    assert cut == 6 * toxicity.PASSAGE + 5


# ---------------------------------------------------------------- samples


def test_samples_need_no_window_over_a_class(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i % 60}", "ab"[i % 2]) for i in range(900)] + [(None, "no id", "a")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i % 50, i % 2) for i in range(300)] + [(None, 1)], "doc_id long, toxic int").withColumn("quality", F.col("toxic"))
    for rows in (langid.training_rows(docs), toxicity.training_rows(docs, labels, "toxic", F.lit(True)), quality_model.training_rows(docs, labels, "quality", F.lit(True))):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan
    assert "TakeOrderedAndProject" in toxicity.training_rows(docs, labels, "toxic", F.lit(True), 5)._jdf.queryExecution().executedPlan().toString()
    rows = toxicity.training_rows(docs, labels, "toxic", F.lit(True), 5).collect()
    assert len(rows) == 10 and len({(r.doc_id, r.y) for r in rows}) == 10  # repeated labels and texts of one id count once
    few = langid.training_rows(docs, sample=10, least=3).collect()
    assert len(few) == 10 and len({(r.doc_id, r.lang, r.text) for r in few}) == 10


def test_more_languages_than_any_cap(spark):
    """Every language of the allowed rows is learned and can be predicted."""
    rng = random.Random(10)
    names = [f"l{k:03d}" for k in range(132)]
    alphabet = [chr(c) for c in range(0x61, 0x7B)]
    parts = {n: ["".join(rng.choice(alphabet) for _ in range(3)) for _ in range(14)] for n in names}
    docs = [(k * 132 + j, " ".join("".join(rng.choice(parts[n]) for _ in range(2)) for _ in range(60)), n) for k in range(16) for j, n in enumerate(names)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.langs == names
    got = langid.predict(df, model).select("lang", "lang_pred").collect()
    assert {r.lang_pred for r in got} == set(names) and np.mean([r.lang == r.lang_pred for r in got]) >= 0.95


def test_average_linkage_equals_means_over_all_pairs():
    rng = np.random.default_rng(12)
    means = rng.random((17, 9)).astype(np.float32)
    unit = means / np.linalg.norm(means, axis=1, keepdims=True)
    like = unit @ unit.T
    groups = [[i] for i in range(17)]
    while len(groups) > 5:
        a, b = max(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: float(like[np.ix_(groups[p[0]], groups[p[1]])].mean()))
        groups[a] = sorted(groups[a] + groups.pop(b))
    assert sorted(langid.families(means)) == sorted(groups)
