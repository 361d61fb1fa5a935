"""Learned sentence boundaries, numbering within groups, counts kept by changes, ensembles as one model, model files by parts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_model import frame, toy

from covarium.functions.register import register
from covarium.operators import boundaries, compose, resample, search, sentences, uncertainty
from covarium.operators.ranking import segmented_index
from covarium.sources import model_store
from covarium.streaming import counts

# ---------------------------------------------------------------- boundaries

WORDS = ["pain", "chest", "fever", "noted", "lungs", "clear", "given", "daily", "stable", "seen", "left", "right", "patient", "today", "abdomen"]
SHORT = ["approx.", "neg.", "resp.", "q.d.", "hosp."]


def planted(rng, n):
    """(text, number of sentences): abbreviations, initials and numbers inside of sentences, which begin with few words."""
    out = []
    for _ in range(n):
        words = [rng.choice(["The", "She", "He", "On"])]
        for _ in range(rng.randrange(4, 12)):
            words.append(rng.choice(SHORT) if rng.random() < 0.2 else rng.choice(WORDS))
            if rng.random() < 0.05:
                words += ["J.", "Smith"]
        out.append(" ".join([*words, rng.choice(WORDS)]) + ".")
    return " ".join(out), n


def test_boundaries_of_planted_abbreviations(spark):
    rng = random.Random(1)
    rows = [(i, *planted(rng, rng.randrange(1, 9))) for i in range(400)] + [(900, None, 0), (901, "", 0), (902, "   ", 0)]
    df = spark.createDataFrame(rows, "id long, text string, want int").repartition(4)
    found = boundaries.learn(df, "text")
    short = {r.type for r in found.abbreviations.collect()}
    assert short == {boundaries._TYPE_EDGE.sub("", s) for s in SHORT}
    assert {r.type for r in found.starters.collect()} == {"the", "she", "he", "on"}
    got = df.withColumn("s", boundaries.splitter(found)(F.col("text"))).collect()
    right = sum(len(r.s) == r.want for r in got)
    assert right >= 0.95 * len(got), right
    assert all(" ".join(r.s) == (r.text or "").strip() for r in got)
    # the rule that knows a fixed list cuts most of them elsewhere
    merged = spark.createDataFrame([(1, 1, rows[0][1])], "SUBJECT_ID long, ROW_ID long, TEXT string")
    assert merged.count() == 1


def test_boundary_scores_equal_the_formulas(spark):
    rng = random.Random(2)
    texts = [planted(rng, 5)[0] for _ in range(80)]
    tokens = [(boundaries._TYPE_EDGE.sub("", w.lower()), w.endswith(".")) for t in texts for w in t.split()]
    n, k = Counter(t for t, _ in tokens), Counter(t for t, s in tokens if s)
    p0 = sum(k.values()) / len(tokens)
    ll = lambda a, b, p: (a * math.log(p) if a else 0) + ((b - a) * math.log(1 - p) if b > a else 0)
    want = {}
    for t in k:
        size = len(t.replace(".", ""))
        if size > 1:
            want[t] = 2 * (ll(k[t], n[t], 0.99) - ll(k[t], n[t], p0)) * math.exp(-size) * (len(t) - size + 1) * size ** -(n[t] - k[t])
    got = {r.type: r.score for r in boundaries.learn(spark.createDataFrame([(t,) for t in texts], "text string"), "text").abbreviations.collect()}
    assert got == pytest.approx({t: s for t, s in want.items() if s >= boundaries.ABBREVIATION}, rel=1e-9)


def test_a_token_ends_a_sentence_or_not():
    know = ({"dr", "e.g"}, {"the"}, {("no", "smith"), ("dr", "the")})
    for text, want in (("Seen by Dr. Smith. The end.", ["Seen by Dr. Smith.", "The end."]), ("Drugs e.g. The one", ["Drugs e.g.", "The one"]), ("Dr. The man", ["Dr. The man"]), ("At 5. then! So? yes", ["At 5. then!", "So?", "yes"]),
                       ("J. Brown no. Smith", ["J. Brown no. Smith"]), ("", []), ("  a.  b ", ["  a.  b "]), ("one. two", ["one. two"])):
        assert boundaries.cut(text, *know) == want


def test_learned_splitter_in_the_sentence_table(spark):
    rng = random.Random(3)
    notes = spark.createDataFrame([(i % 3, i, planted(rng, 4)[0]) for i in range(60)], "SUBJECT_ID long, ROW_ID long, TEXT string")
    found = boundaries.splitter(boundaries.learn(notes))
    cut = notes.select("SUBJECT_ID", "ROW_ID", found(F.col("TEXT")).alias("Sentences"))
    assert sentences.totals(cut).first().n_notes == 60 and abs(sentences.totals(cut).first().n_sentences - 240) <= 5


# ---------------------------------------------------------------- numbering within groups


def test_numbers_within_groups_equal_a_window(spark):
    rows = [(("hot" if i % 2 else None if i % 5 == 0 else f"k{i % 7}"), i * 37 % 1009) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(6)
    got = segmented_index(df, ["k"], [F.col("v")], "n", 8)
    seen = {}
    for k, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        seen.setdefault(k, []).append(v)
    assert sorted((str(r.k), r.v, r.n) for r in got.collect()) == sorted((str(k), v, n) for k, vs in seen.items() for n, v in enumerate(vs))
    assert segmented_index(df.limit(0), ["k"], [F.col("v")], "n").count() == 0


def test_one_patient_with_half_of_all_notes_spans_tasks(spark):
    notes = spark.createDataFrame([(1 if i % 2 else 2 + i % 40, i) for i in range(2000)], "patient long, note long")
    spread_over = segmented_index(notes, ["patient"], [F.col("note")], "n", 8).filter("patient = 1").select(F.spark_partition_id().alias("p")).distinct().count()
    drawn = resample.bootstrap_notes(notes, 5, "patient", "note")
    plan = drawn._jdf.queryExecution().toString()
    assert not re.search(r"windowspecdefinition\(patient#\d+L?, note", plan) and spread_over > 1
    assert drawn.count() == drawn.groupBy("instance", "draw").count().count()


# ---------------------------------------------------------------- streaming


def test_counts_are_kept_by_changes(spark, tmp_path):
    at = str(tmp_path)
    want = Counter()

    def lines(k, words):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.txt").write_text("".join(f"p ||| e ||| {w}\n" for w in words))
        for w in words:
            want.update([("word", w), ("patient", "p"), ("encounter", "e")])

    def run():
        counts.start_counts_to_parquet(counts.read_corpus(spark, f"{at}/in", 1), f"{at}/out", f"{at}/check", 3).awaitTermination()

    assert counts.read_counts(spark, f"{at}/out").count() == 0
    lines(0, ["a"] * 3 + [f"w{i}" for i in range(200)])
    run()
    before = spark.read.parquet(f"{at}/out/changes/batch=0").count()
    lines(1, ["a", "b"])
    run()
    assert before == 203 and spark.read.parquet(f"{at}/out/changes/batch=1").count() == 4  # a, b, p, e
    for k in range(2, 6):
        lines(k, ["a", f"x{k}"])
        run()
        assert {(r.group_name, r.token): r.freq for r in counts.read_counts(spark, f"{at}/out").collect()} == want
    assert len(counts._numbers(spark, f"{at}/out/base")) == 1 and len(counts._numbers(spark, f"{at}/out/changes")) <= 2
    counts.compact(spark, f"{at}/out", 5)  # repeating it changes nothing
    assert {(r.group_name, r.token): r.freq for r in counts.read_counts(spark, f"{at}/out").collect()} == want


# ---------------------------------------------------------------- ensembles and files


def test_an_ensemble_is_one_plan_whatever_its_size(spark, tmp_path):
    models = {i: toy(spark, i)[0] for i in range(4)}
    for i, m in models.items():
        model_store.save(m, str(tmp_path / ("m" + (f"_boot_{i}" if i else ""))))
    q = frame(spark, [(0, ["chest", "pain"], ["male"], []), (1, ["rash", "unseen"], [], ["icu"])])
    whole = model_store.ensemble(spark, str(tmp_path), "m")
    assert whole.replicates == (0, 1, 2, 3)
    got = {(r.replicate_id, r.qid): r.vec for r in compose.combined(q, whole).collect()}
    for i, m in models.items():
        for r in compose.combined(q, m).collect():
            assert got[i, r.qid] == pytest.approx(r.vec, abs=1e-6)
    size = lambda m: len(uncertainty.ensemble_intervals(m, q, q)._jdf.queryExecution().optimizedPlan().toString().splitlines())
    for i in (2, 3):
        (tmp_path / f"m_boot_{i}").rename(tmp_path / f"gone_{i}")
    few = model_store.ensemble(spark, str(tmp_path), "m")
    assert few.replicates == (0, 1) and size(few) == size(whole)
    odd = toy(spark, 9, d=(7, 3, 2, 5))[0]
    with pytest.raises(ValueError, match="differ"):
        model_store.stacked({0: models[0], 1: odd})


def test_matrices_of_a_file_are_read_and_written_by_tasks(spark, tmp_path, monkeypatch):
    m, a, _ = toy(spark)
    sparse = m.matrices.filter("matrix <> 'ngram' OR row_idx % 3 = 0")
    part = model_store.Model(m.meta, m.vocab, sparse)
    path = str(tmp_path / "m.bin")
    model_store.write_binary(part, path)
    assert (tmp_path / "m.bin").read_bytes() == model_store.to_binary(part)
    monkeypatch.setattr(model_store, "CHUNK", 64)
    monkeypatch.setattr(model_store, "_put", lambda *args: pytest.fail("a matrix went through the driver") if "matrices" in args[1] else real(*args))
    back = model_store.from_binary(spark, f"file://{path}")
    assert back.matrices.rdd.getNumPartitions() > 10
    for k, v in a.items():
        rows = {r.row_idx: r.vec for r in back.matrix(k).collect()}
        want = np.where((np.arange(len(v)) % 3 == 0)[:, None] | (k != "ngram"), v, 0)
        assert np.array([rows[i] for i in range(len(v))], np.float32) == pytest.approx(want)
    monkeypatch.setattr(model_store, "opens", lambda _: False)
    monkeypatch.setattr(model_store, "_put", real)
    other = model_store.from_binary(spark, path)
    assert sorted(map(tuple, other.matrices.collect())) == sorted(map(tuple, back.matrices.collect()))
    (tmp_path / "short.bin").write_bytes((tmp_path / "m.bin").read_bytes()[:400])
    with pytest.raises(EOFError):
        model_store.from_binary(spark, str(tmp_path / "short.bin"))


def test_a_model_stored_by_row_is_joined_where_it_lies(spark, tmp_path):
    m, _, names = toy(spark)
    at = str(tmp_path / "m")
    model_store.save(m, at, 4)
    back = model_store.load(spark, at)
    words = spark.createDataFrame([(w,) for w in [*names[0], "unseen", "é"]], "token string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        shuffles = [compose.word_rows(words, x, ["token"])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(row_idx") for x in (m, back)]
        got = {r.token: r.vec for r in compose.word_vectors(words, back).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert shuffles == [4, 2]  # the words' sides alone
    for r in compose.word_vectors(words, m).collect():
        assert got[r.token] == pytest.approx(r.vec, abs=1e-9)
    assert back.meta == m.meta and back.matrices.count() == m.matrices.count()
    model_store.save(toy(spark, 1)[0], str(tmp_path / "m_boot_1"), 4)
    whole = compose.combined(frame(spark), model_store.ensemble(spark, str(tmp_path), "m"))
    assert whole.filter("replicate_id = 0").count() == 4 and {r.qid: r.vec for r in whole.filter("replicate_id = 0").collect()}[1] == pytest.approx({r.qid: r.vec for r in compose.combined(frame(spark), m).collect()}[1], abs=1e-6)


real = model_store._put


def test_table_function_and_aggregate(spark):
    register(spark, 3, 3, 1000)
    got = spark.sql("SELECT t.x, g.gram FROM VALUES ('ab'), (NULL), ('é') AS t(x), LATERAL ngrams(t.x) AS g").collect()
    assert sorted((r.x, r.gram) for r in got) == [("ab", "<ab"), ("ab", "ab>"), ("é", "<é>")]
    r = spark.sql("SELECT k, vec_mean(v) AS m FROM VALUES (1, array(1D, 2D)), (1, array(3D, 4D)), (1, NULL), (2, NULL) AS t(k, v) GROUP BY k ORDER BY k").collect()
    assert r[0].m == [2.0, 3.0] and r[1].m is None


def test_neighbours_in_groups_and_parts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BYTES", 200)
    monkeypatch.setattr(search, "PART_ROWS", 90)
    monkeypatch.setattr(search, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    v = rng.integers(-3, 4, size=(300, 6)).astype(float)  # many ties
    v[5] = 0
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
    c = spark.createDataFrame([(i, f"w{i}", x.tolist(), float(np.linalg.norm(x))) for i, x in enumerate(v)], "idx long, token string, vec array<double>, norm double").repartition(7)
    got = {}
    for r in search.nearest(c.filter("idx % 10 = 0 OR idx = 5").select(F.concat(F.lit("q"), F.col("idx")).alias("qid"), "vec"), c, 9).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.idx, r.token))
    live = [i for i in range(0, 300, 10) if v[i].any()]
    assert set(got) == {f"q{i}" for i in live}
    for i in live:
        sims = np.array([float((unit[i] * u).sum()) for u in unit])
        near = [j for j in np.lexsort((np.arange(300), -np.round(sims, 12))) if v[j].any()][:9]
        assert [np.round(sims[j], 9) for _, j, _ in sorted(got[f"q{i}"])] == [np.round(sims[j], 9) for j in near] and all(t == f"w{j}" for _, j, t in got[f"q{i}"])
    assert search.nearest(c.limit(0).select(F.col("idx").alias("qid"), "vec"), c, 3).count() == 0


def test_texts_are_cut_a_few_at_a_time():
    """The sentences of a batch of texts are those of each text, while Python holds those of a few texts only."""
    import tracemalloc

    import pyarrow as pa

    together = boundaries.Pairs(["approx", "approx", "b"], ["Five".lower(), "six", "six"])
    assert ("approx", "six") in together and ("b", "five") not in together and ("c", "six") not in together
    know = ({"approx"}, {"the"}, together)
    one = "It took approx. five days. The rest was short! " * 200
    texts = pa.array([None, "", *[f"{i} {one}" for i in range(1000)]])
    tracemalloc.start()
    got = boundaries.cut_all(texts, *know)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 1002 and got[0].as_py() == got[1].as_py() == [] and len(boundaries.cut_all(texts[:0], *know)) == 0
    assert all(got[i].as_py() == boundaries.cut(texts[i].as_py(), *know) for i in (2, 65, 66, 1001))
    assert peak < 6 << 20  # all sentences as Python strings: 40 MB


def test_tokens_are_counted_before_they_become_types(spark):
    """(type, stop, next) with counts equal a plain loop, and the texts are read once."""
    texts = ["Dr. Who came. (Then) he left. Dr. who", None, "", "end.", "Then DR. Who then, then."]
    kind = lambda w: boundaries._TYPE_EDGE.sub("", w.lower())
    want = {}
    for t in texts:
        w = (t or "").split()
        for x, y in zip(w, [*w[1:], None]):
            key = (kind(x), x.endswith("."), kind(y) if y is not None and x.endswith(".") else None)
            want[key] = want.get(key, 0) + 1
    got = boundaries.token_rows(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()
    assert {(r.type, r.stop, r.next): r.n for r in got} == want and len(got) == len(want)
