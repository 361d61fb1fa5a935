"""Text, vector, hash and category functions, on small frames with known results."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from covarium.functions import categories, hashing, text, vectors
from covarium.functions.register import register


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize("line, groups", [("elderly male ||| ||| no acute distress", 2), ("elderly male |||  ||| no acute distress", 3), ("a ||| b ||| c ||| d", 4), ("", 1)])
def test_strict_groups(spark, line, groups):
    assert len(one(spark, text.split_groups(F.col("v")), v=line)) == groups


def test_tokens_follow_the_c_locale(spark):
    assert one(spark, text.tokens(F.col("v")), v=" a\tb c  d\r") == ["a", "b c", "d"]


def test_clean_text_collapses_then_drops(spark):
    assert one(spark, text.clean_text(F.col("v")), v="  a \n b​c \x07 ") == "a bc "


def test_sentences(spark):
    s = one(spark, text.sentences(F.col("v"), 5), v="Pt [**2101-1-1**] seen, a-b/c\\d.e ok. Temp 38.5 was high! x. Dr. Who [** a. b **] here")
    assert s == ["pt seen a-b/c\\de ok", "temp was high", "who a"] or s[:2] == ["pt seen a-b/c\\de ok", "temp was high"]
    assert one(spark, F.array_join(text.letter_tokens(F.col("v")), " "), v="a-b/c\\d.e,f'g 9x ٣x") == "a-b/c\\defg"


@pytest.mark.parametrize("n, kept", [(19, 0), (20, 1)])
def test_sentence_length_is_measured_after_cleaning(spark, n, kept):
    assert len(one(spark, text.sentences(F.col("v")), v="a" * n + " 123456789.")) == kept


def test_group_string_drops_null_and_unknown(spark):
    df = spark.createDataFrame([("A b", None, "Unknown (x)")], "p string, q string, r string")
    assert df.select(text.group_string(["p", "q", "r"]).alias("g")).first().g == "p:A_b"


def test_categories(spark):
    df = spark.createDataFrame([(" RN ",), ("Co-Ord",), ("MS,RD",), ("zzz",), (None,)], "v string")
    got = df.select(categories.recode(F.col("v"), categories.DICTIONARIES["caregiver_role"]).alias("a"), categories.caregiver_title(F.col("v")).alias("b")).collect()
    assert [r.a for r in got] == ["nurse", "coordinator", "dietitian", "unknown", "unknown"]
    assert [r.b for r in got] == ["nurse", "coordinator", "dietitian", "other", "other"]
    assert one(spark, categories.religion(F.lit("GREEK ORTHODOX"))) == "orthodox"
    assert one(spark, categories.language(F.lit("*CHI"))) == "chinese"
    assert one(spark, categories.ethnicity(F.lit("ASIAN - THAI"))) == "asian"


@pytest.mark.parametrize("word, bucket", [("<pain>", 67683), ("<a", 244782), ("chest", 617366), ("hemat", 756892)])
def test_fnv_known_values(spark, word, bucket):
    assert hashing.fnv_bucket_py(word.encode(), 2_000_000) == bucket
    assert one(spark, hashing.fnv_bucket(hashing.codes(F.lit(word)), 2_000_000)) == bucket


def test_fnv_modes_differ_beyond_ascii(spark):
    assert hashing.fnv_bucket_py("naïve".encode(), 2_000_000) == 438955
    assert hashing.fnv_bucket_py("naïve", 2_000_000) == 1908428
    assert one(spark, hashing.fnv_bucket(hashing.codes(F.lit("naïve")), 2_000_000)) == 438955
    assert one(spark, hashing.fnv_bucket(hashing.codes(F.lit("naïve"), "codepoint"), 2_000_000, "codepoint")) == 1908428


@pytest.mark.parametrize("mode", ["byte", "codepoint"])
def test_ngram_buckets_agree_in_all_forms(spark, mode):
    words = ["", "a", "ab", "pain", "naïve", "日本語", "hematology"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select("w", hashing.ngram_buckets(F.col("w"), 3, 6, 5000, mode).alias("a")).collect()
    arrow = df.select("w", hashing.ngram_buckets_udf(3, 6, 5000, mode)("w").alias("a")).collect()
    for r, s in zip(got, arrow, strict=True):
        assert list(r.a) == list(s.a) == hashing.ngram_buckets_py(r.w, 3, 6, 5000, mode)
    texts = df.filter("w = 'pain'").select(hashing.ngram_texts(F.col("w"), 3, 4).alias("g")).first().g
    assert texts == ["<pa", "pai", "ain", "in>", "<pai", "pain", "ain>"]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=20))
def test_fnv_equals_big_integers(data):
    h = 14695981039346656037
    for c in data:
        h = ((h ^ (c if c < 128 else c - 256)) % (1 << 64)) * 1099511628211 % (1 << 64)
    assert hashing.fnv_bucket_py(data, 999_983) == h % 999_983


def test_portable_int(spark):
    assert one(spark, hashing.portable_int(F.lit("7-3"))) == 3584842279


def test_vectors(spark):
    rng = random.Random(1)
    a, b = [rng.uniform(-1, 1) for _ in range(7)], [rng.uniform(-1, 1) for _ in range(7)]
    dot = sum(x * y for x, y in zip(a, b, strict=True))
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    A, B = F.col("a"), F.col("b")
    get = lambda e: one(spark, e, a=a, b=b)
    assert get(vectors.dot(A, B)) == pytest.approx(dot)
    assert get(vectors.cosine(A, B)) == pytest.approx(dot / na / nb)
    assert get(vectors.euclid(A, B)) == pytest.approx(math.sqrt(2 - 2 * dot / na / nb))
    assert get(vectors.norm(vectors.normalized(A))) == pytest.approx(1)
    assert get(vectors.cosine(A, vectors.scale(B, F.lit(0.0)))) is None
    rows = F.array(A, B)
    assert get(vectors.matvec(rows, A)) == pytest.approx([na * na, dot])
    assert get(vectors.matvec_transposed(rows, F.array(F.lit(2.0), F.lit(-1.0)))) == pytest.approx([2 * x - y for x, y in zip(a, b, strict=True)])
    outer = get(vectors.add_outer(rows, F.array(F.lit(1.0), F.lit(2.0)), A, F.lit(0.5)))
    assert outer[1] == pytest.approx([y + x for x, y in zip(a, b, strict=True)])
    assert get(vectors.norm(vectors.clip_norm(A, 0.1))) == pytest.approx(0.1) and get(vectors.norm(vectors.clip_norm(A, 0.0))) == pytest.approx(na)
    assert get(vectors.sigmoid(F.lit(100.0))) == pytest.approx(1 / (1 + math.exp(-20)))
    assert get(vectors.finite_or_zero(F.array(F.lit(1.0), F.lit(float("nan"))))) == [0.0, 0.0]


@pytest.mark.parametrize("cos, label", [(0.81, "Very similar"), (0.8, "Moderately similar"), (0.5, "Weakly similar"), (0.2, "Unrelated"), (-0.2, "Opposite")])
def test_similarity_labels_are_strict(spark, cos, label):
    assert one(spark, vectors.similarity_label(F.lit(cos))) == label


def test_registered_sql_functions(spark):
    assert "vec_dot" in register(spark, 3, 4, 5000)
    r = spark.sql("SELECT vec_dot(array(1D, 2D), array(3D, 4D)) AS d, vec_norm(array(3D, 4D)) AS n, corpus_tokens(' a  b ') AS t, size(corpus_groups('a ||| b ||| c')) AS g, ngram_buckets('pain') AS b").first()
    assert (r.d, r.n, r.t, r.g) == (11.0, 5.0, ["a", "b"], 3) and list(r.b) == hashing.ngram_buckets_py("pain", 3, 4, 5000)
