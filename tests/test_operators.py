"""Corpus, covariate, vocabulary, sampling and ranking operators."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from covarium.operators import covariates, huffman, resample, sentences, skipgram, vocabulary
from covarium.operators.ranking import dense_index
from covarium.sources import corpus
from covarium.streaming import counts


def lines(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, value string")


CORPUS = ["elderly male ||| nurse ||| no acute distress", " |||  ||| no distress", "elderly ||| ||| one space only", "a ||| b ||| ", "x ||| y ||| z ||| w", "", "p  q ||| r ||| no gap here\r"]


def test_strict_and_lenient_readers(spark):
    df = lines(spark, *CORPUS)
    strict = {r.id: r for r in corpus.training_samples(df).collect()}
    assert sorted(strict) == [0, 1, 6]
    assert strict[0].patient == ["elderly", "male"] and strict[1].patient == [] and strict[6].words == ["no gap", "here"]
    assert sorted(r.id for r in corpus.counting_samples(df).collect()) == [0, 1, 3, 6]
    bad = {r.id: r.reason for r in corpus.bad_records(df).collect()}
    assert bad == {2: "groups", 3: "no_words", 4: "groups", 5: "groups"}
    assert corpus.count_lines(df) == 6


def test_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a b", None, "w1 w2"), (None, "c", "w3")], "p string, e string, s string")
    corpus.write_lines(df, str(tmp_path / "c"), corpus.line(F.col("p"), F.col("e"), F.col("s")))
    got = corpus.training_samples(corpus.read_lines(spark, str(tmp_path / "c")))
    assert sorted((r.patient, r.encounter, r.words) for r in got.collect()) == [([], ["c"], ["w3"]), (["a", "b"], [], ["w1", "w2"])]


def test_query_triples(spark):
    df = lines(spark, "chest pain|||elderly|||nurse", "   ", "pain ||| ||| ||| more")
    got = {r.id: (r.words, r.patient, r.encounter) for r in corpus.query_triples(df).collect()}
    assert got == {0: (["chest", "pain"], ["elderly"], ["nurse"]), 2: (["pain"], [], [])}
    with pytest.raises(Exception, match="fewer than three"):
        corpus.query_triples(lines(spark, "a ||| b")).collect()


def test_synthetic_corpus(spark):
    got = corpus.synthetic_corpus(spark, 500, 1)
    assert got.count() == 500 and corpus.training_samples(got).count() == 500
    assert sorted(got.collect()) == sorted(corpus.synthetic_corpus(spark, 500, 1).repartition(3).collect())
    rows = corpus.training_samples(got).collect()
    assert {len(r.patient) for r in rows} == set(range(6)) and {len(r.encounter) for r in rows} == {0, 1, 2}
    assert not any("{" in r.value for r in rows)


def test_csv_to_parquet_keeps_line_ends(spark, tmp_path):
    (tmp_path / "n.csv").write_text('row_id,SUBJECT_ID,HADM_ID,CGID,TEXT\n1,2,,x,"a ""b""\nc"\n')
    corpus.csv_to_parquet(spark, str(tmp_path / "n.csv"), str(tmp_path / "n.parquet"), corpus.NOTES)
    r = spark.read.parquet(str(tmp_path / "n.parquet")).first()
    assert (r.ROW_ID, r.SUBJECT_ID, r.HADM_ID, r.CGID, r.TEXT) == (1, 2, None, None, 'a "b"\nc')
    assert corpus.missing_files(spark, [str(tmp_path / "n.csv"), str(tmp_path / "no.csv")]) == [str(tmp_path / "no.csv")]


# ---------------------------------------------------------------- covariates


def merged(spark):
    notes = spark.createDataFrame([(1, 10, 100, 7, "t1"), (2, 11, None, None, None), (3, 12, 101, 8, "t3"), (4, None, 102, 9, "t4")], corpus.NOTES)
    pat = spark.createDataFrame([(10, "1940-01-01 00:00:00", "M"), (11, None, "F"), (12, "bad", "F")], corpus.PATIENTS)
    adm = spark.createDataFrame(
        [(100, "2020-01-01 23:00:00", "2020-01-04 22:00:00", "EMERGENCY", "Self Pay", "ENGL", "CATHOLIC", "UNKNOWN (DEFAULT)", "WHITE", 1), (101, "2020-01-01 00:00:00", "2020-01-31 00:00:00", "ELECTIVE", "Medicare", "XX", None, "MARRIED", "ASIAN - THAI", None), (102, "nope", None, None, None, None, None, None, None, 0)],
        corpus.ADMISSIONS,
    )
    cg = spark.createDataFrame([(7, " RN "), (8, "zzz"), (9, None)], corpus.CAREGIVERS)
    return covariates.merge_notes(notes, pat, adm, cg)


def test_merge_notes(spark):
    r = {x.ROW_ID: x for x in merged(spark).collect()}
    assert len(r) == 4
    assert (r[1].age_group, r[1].gender, r[1].length_of_stay, r[1].mortality, r[1].caregiver_role) == ("elderly", "m", "short", "dead", "nurse")
    assert (r[1].insurance, r[1].marital_status, r[1].religion, r[1].language) == ("self_pay", "unknown_(default)", "catholic", "english")
    assert (r[2].mortality, r[2].age_group, r[2].length_of_stay, r[2].caregiver_role) == (None, "infant", "short", "unknown")
    assert (r[3].mortality, r[3].length_of_stay, r[3].ethnicity, r[3].age_group) == ("alive", "long", "asian", "infant")
    assert r[4].gender is None and r[4].mortality == "alive"
    g = {x.ROW_ID: x for x in covariates.with_groups(merged(spark)).collect()}
    assert g[1].patient_group == "age_group:elderly gender:m ethnicity:white language:english religion:catholic insurance:self_pay"
    assert g[2].encounter_group == "length_of_stay:short"


@pytest.mark.parametrize("a, b, days", [("2020-01-03 01:00:00", "2020-01-01 23:00:00", 1), ("2020-01-01 01:00:00", "2020-01-02 23:00:00", -1)])
def test_whole_days(spark, a, b, days):
    assert spark.range(1).select(covariates.whole_days(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp")).alias("d")).first().d == days


@pytest.mark.parametrize("years, label", [(80, "Elderly"), (79, "Aged"), (65, "Aged"), (64, "Middle_Aged"), (45, "Middle_Aged"), (24, "Adult"), (19, "Young_Adult"), (13, "Adolescent"), (2, "Child"), (1, "Infant"), (None, "Infant")])
def test_age_limits(spark, years, label):
    assert spark.range(1).select(covariates.age_group(F.lit(years).cast("int")).alias("g")).first().g == label


def test_null_bucket_option(spark):
    assert spark.range(1).select(covariates.bucket(F.lit(None).cast("int"), covariates.STAY_BUCKETS, "Short", "none").alias("g")).first().g == "none"


def test_sentence_table_and_splitter_hook(spark):
    m = spark.createDataFrame([(1, 1, "First sentence is long enough. Tiny. Another sentence that is long."), (1, 2, "short"), (2, 3, None)], "SUBJECT_ID long, ROW_ID long, TEXT string")
    m = m.withColumns({c: F.lit("v") for c in covariates.PATIENT_COLS + covariates.ENCOUNTER_COLS})
    t = sentences.sentence_table(m)
    assert [r.Sentences for r in t.collect()] == [["first sentence is long enough", "another sentence that is long"]]
    hook = sentences.sentence_table(m, 3, sentences.arrow_splitter(lambda s: s.split(". ")))
    assert {r.ROW_ID: len(r.Sentences) for r in hook.collect()} == {1: 3, 2: 1}
    assert tuple(sentences.totals(t).first()) == (1, 1, 2)


# ---------------------------------------------------------------- vocabulary


def test_counts_and_vocabularies(spark):
    s = corpus.counting_samples(lines(spark, "a b ||| n ||| x y x", "a ||| n ||| y z", "c ||| n ||| "))
    c = vocabulary.token_counts(s)
    assert {(r.group_name, r.token): r.freq for r in c.collect()} == {("word", "x"): 2, ("word", "y"): 2, ("word", "z"): 1, ("patient", "a"): 2, ("patient", "b"): 1, ("patient", "c"): 1, ("encounter", "n"): 3}
    v = vocabulary.vocabularies(c, 2)
    assert [(r.idx, r.token, r.freq) for r in v["word"].orderBy("idx").collect()] == [(0, "x", 2), (1, "y", 2)]
    assert v["patient"].count() == 3
    assert tuple(vocabulary.summary(c, 2).first()) == (3, 2, 1, 4, 3, 1)
    assert [r.token for r in vocabulary.field_dump(v["patient"]).collect()] == ["a", "b", "c"]
    looked = vocabulary.lookup(spark.createDataFrame([("x",), ("q",)], "token string"), v["word"]).collect()
    assert {r.token: r.idx for r in looked} == {"x": 0, "q": -1}
    back = vocabulary.reverse_lookup(spark.createDataFrame([(1,), (9,)], "idx long"), v["word"]).collect()
    assert {r.idx: r.token for r in back} == {1: "y", 9: ""}


def test_discard_probabilities(spark):
    v = spark.createDataFrame([(i, f"t{i}", f) for i, f in enumerate([10, 6, 5, 3, 2])], "idx long, token string, freq long")
    got = [round(r.discard_prob, 6) for r in vocabulary.with_discard(v, 0.1).orderBy("idx").collect()]
    assert got == [0.490098, 0.341719, 0.27889, 0.069051, 0.0]


def test_huffman_known_codes():
    made = list(huffman.codes(np.array([10, 6, 5, 3, 2])))
    assert ["".join(map(str, c)) for c, _ in made] == ["11", "10", "00", "011", "010"]
    assert [p for _, p in made] == [[3, 2], [3, 2], [3, 1], [3, 1, 0], [3, 1, 0]]
    assert list(huffman.codes(np.array([4]))) == [([], [])] and list(huffman.codes(np.array([], np.int64))) == []


@pytest.mark.parametrize("n", [2, 3, 17, 400])
def test_huffman_is_optimal_and_prefix_free(n):
    f = np.sort(np.random.default_rng(n).integers(1, 1000, n))[::-1]
    made = list(huffman.codes(f))
    assert sum(len(c) * x for (c, _), x in zip(made, f.tolist(), strict=True)) == huffman.least_weighted_length(f)
    words = sorted("".join(map(str, c)) for c, _ in made)
    assert not any(b.startswith(a) for a, b in zip(words, words[1:], strict=False))
    assert {x for _, p in made for x in p} == set(range(n - 1)) and all(p[0] == n - 2 for _, p in made)


def plain_merge(freqs):
    """The merge of one pair of nodes after the other."""
    v = len(freqs)
    parent, bit, w = [-1] * (2 * v - 1), [0] * (2 * v - 1), list(freqs) + [0] * (v - 1)
    leaf, inner = v - 1, v
    for node in range(v, 2 * v - 1):
        for b in (0, 1):
            if leaf >= 0 and (inner >= node or w[leaf] <= w[inner]):
                at, leaf = leaf, leaf - 1
            else:
                at, inner = inner, inner + 1
            w[node] += w[at]
            parent[at], bit[at] = node, b
    out = []
    for at in range(v):
        code, path = [], []
        while parent[at] >= 0:
            code, at = [bit[at], *code], parent[at]
            path = [at - v, *path]
        out.append((code, path))
    return out


@pytest.mark.parametrize("most", [1, 2, 5, 40, 10_000])
def test_huffman_by_classes_equals_the_plain_merge(most):
    rng = np.random.default_rng(most)
    for _ in range(60):
        f = np.sort(rng.integers(1, most + 1, int(rng.integers(1, 70))))[::-1]
        assert list(huffman.codes(f)) == plain_merge(f.tolist())
    f = np.sort((3e5 / np.arange(1, 100_001)).astype(int) + 1)[::-1]
    t = huffman.tree(*np.unique(f, return_counts=True))
    assert len(t.leaves.low) + len(t.inner.low) < 10_000  # of 200,000 nodes


def test_huffman_stats(spark):
    v = spark.createDataFrame([(i, f"t{i}", f) for i, f in enumerate([10, 6, 5, 3, 2])], "idx long, token string, freq long")
    r = huffman.depth_stats(huffman.with_codes(v)).first()
    assert (r.words, r.min_depth, r.max_depth, r.avg_depth, r.zero_depth, r.weighted_length) == (5, 2, 3, 2, 0, 57)


def test_dense_index_equals_a_global_sort(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 13).alias("k"))
    got = dense_index(df, [F.desc("k"), F.asc("id")]).collect()
    want = sorted(((-r.k, r.id) for r in got))
    assert [(-r.k, r.id) for r in sorted(got, key=lambda r: r.idx)] == want and sorted(r.idx for r in got) == list(range(1000))
    assert dense_index(df.limit(0), [F.asc("id")]).count() == 0


# ---------------------------------------------------------------- sampling


def test_bootstrap(spark):
    notes = spark.createDataFrame([(p, p * 100 + i) for p in range(20) for i in range(p % 4 + 1)], "SUBJECT_ID long, ROW_ID long")
    sizes = Counter(r.SUBJECT_ID for r in notes.collect())
    got = resample.bootstrap_notes(notes, None, "SUBJECT_ID", "ROW_ID", [1, 2]).collect()
    per = defaultdict(list)
    for r in got:
        per[r.replicate_id, r.instance].append(r)
    assert len(per) == 40
    for rows in per.values():
        p = rows[0].SUBJECT_ID
        assert {r.SUBJECT_ID for r in rows} == {p} and len(rows) == sizes[p] and all(r.ROW_ID // 100 == p for r in rows)
    assert sorted(got) == sorted(resample.bootstrap_notes(notes.repartition(5), None, "SUBJECT_ID", "ROW_ID", [1, 2]).collect())


def test_expand_keeps_repeats(spark):
    table = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["c"])], "SUBJECT_ID long, ROW_ID long, Sentences array<string>")
    drawn = spark.createDataFrame([(1, 1), (1, 1)], "SUBJECT_ID long, ROW_ID long")
    assert sorted(r.sentence for r in resample.expand(drawn, table).collect()) == ["a", "a", "b", "b"]


def test_expand_brings_like_notes_together(spark):
    table = spark.createDataFrame([(i, i, f"g{i * 7 % 5}", ["a", "b"]) for i in range(60)], "SUBJECT_ID long, ROW_ID long, g string, Sentences array<string>")
    drawn = spark.createDataFrame([(i, i) for i in [*range(60), 3]], "SUBJECT_ID long, ROW_ID long")
    got = resample.expand(drawn, table, near=["g"]).withColumn("part", F.spark_partition_id()).collect()
    for part in {r.part for r in got}:
        assert (gs := [r.g for r in got if r.part == part]) == sorted(gs)
    assert sorted((r.ROW_ID, r.sentence) for r in got) == sorted((r.ROW_ID, r.sentence) for r in resample.expand(drawn, table).collect())


def test_shuffle_is_seeded(spark):
    df = spark.range(200)
    a = [r.id for r in resample.shuffled(df, 1, ["id"]).collect()]
    assert a == [r.id for r in resample.shuffled(df.repartition(9), 1, ["id"]).collect()] != list(range(200))
    assert a != [r.id for r in resample.shuffled(df, 2, ["id"]).collect()]
    assert (resample.shuffle_seed(None, None), resample.shuffle_seed(3, None), resample.shuffle_seed(3, 4)) == (42, 3, 4)


def test_skipgram_pairs(spark):
    s = spark.createDataFrame([(0, list("abcdefgh")), (1, ["x"]), (2, [])], "id long, words array<string>")
    got = skipgram.pairs(s, ["id"], 3).collect()
    by = defaultdict(set)
    for r in got:
        assert r.id == 0 and r.word == "abcdefgh"[r.pos] and r.context == "abcdefgh"[r.ctx_pos]
        by[r.pos].add(r.ctx_pos)
    for pos, ctx in by.items():
        w = max(abs(c - pos) for c in ctx)
        assert 1 <= w <= 3 and ctx == {c for c in range(8) if 1 <= abs(c - pos) <= w}
    v = spark.createDataFrame([(c, 0.0) for c in "abcd"] + [("e", 1.0)], "token string, discard_prob double")
    kept = skipgram.kept(skipgram.pairs(s, ["id"], 3), v, ["id"]).collect()
    assert {r.word for r in kept} <= set("abcd") and {r.context for r in kept} <= set("abcd") and kept


# ---------------------------------------------------------------- streaming


def test_streaming_counts_equal_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.txt").write_text("\n".join(["a ||| n ||| x y", f"b ||| n ||| x z{i}", "bad line"]) + "\n")
    q = counts.start_counts(counts.read_corpus(spark, str(tmp_path / "in"), 1), "running", str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {(r.group_name, r.token): r.freq for r in spark.table("running").collect()}
    batch = vocabulary.token_counts(corpus.counting_samples(corpus.read_lines(spark, str(tmp_path / "in"))))
    assert got == {(r.group_name, r.token): r.freq for r in batch.collect()} and got["word", "x"] == 6


def test_rows_are_numbered_where_they_were_dealt(spark):
    """Dense positions need one shuffle by ranges; neither a window nor a second shuffle moves the rows again."""
    from covarium.operators.ranking import segmented_index

    df = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(1009)).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    got = dense_index(df, [F.col("v")], "place", 7)
    assert [(r.place, r.v) for r in got.orderBy("place").collect()] == list(enumerate(sorted(r.v for r in df.collect())))
    assert "row_number" not in got._jdf.queryExecution().optimizedPlan().toString()
    got = segmented_index(df, ["g"], [F.col("v")], "place", 7)
    assert "row_number" not in got._jdf.queryExecution().optimizedPlan().toString()
    by = {}
    for r in sorted(df.collect(), key=lambda r: r.v):
        by.setdefault(r.g, []).append(r.v)
    assert {(r.g, r.place, r.v) for r in got.collect()} == {(g, i, v) for g, vs in by.items() for i, v in enumerate(vs)}


def test_lines_have_their_places_in_the_files(spark, tmp_path):
    """Files of many splits, several to a task and several tasks to a file."""
    (tmp_path / "c").mkdir()
    want = []
    for i, n in enumerate((300, 0, 5, 900)):
        lines = [f"line {j} of {i} " + "x" * (j % 13) if j % 10 else "" for j in range(n)]
        (tmp_path / "c" / f"part-{i:05}").write_text("".join(x + "\n" for x in lines))
        want += lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = corpus.placed_lines(spark, str(tmp_path / "c"))
        assert "RepartitionByExpression" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert [(r.place, r.value) for r in got.orderBy("place").collect()] == list(enumerate(want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
