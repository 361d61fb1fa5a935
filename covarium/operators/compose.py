"""Vectors of words and of stratified queries, composed from model tables by joins.

A query has words, patient tokens and encounter tokens. Words are averaged over all words of the query, known or not; groups over their known tokens; repeats count each
time. The three means, one after the other, go through the projection and get unit length.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.functions.hashing import ngram_buckets
from covarium.functions.vectors import MIN_NORM, divide, finite_or_zero, matvec, norm, normalized
from covarium.sources.model_store import Model


def sum_vectors(rows: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Element-wise sums: one row for each key, with `vec` and `n`, the number of rows. A vector aggregate adds whole vectors in each task before the shuffle, so a hot key is one row a task."""
    made = rows.select(*keys, array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("_v"))
    return made.groupBy(*keys).agg(Summarizer.sum(F.col("_v")).alias("_s"), F.count(F.lit(1)).alias("n")).select(*keys, vector_to_array("_s").alias(vec), "n")


def zeros(d: int) -> Column:
    return F.array_repeat(F.lit(0.0), d)


def word_rows(words: DataFrame, model: Model, keys: list[str], token: str = "token", mode: str = "byte") -> DataFrame:
    """(keys, vec): the vectors to be added for each word: its own, if it is in the vocabulary, and those of all its n-grams, repeats included. `keys` has replicate_id if the model is an ensemble."""
    m = model.meta
    own = words.join(model.words().select(*model.by, F.col("token").alias(token), F.col("idx").alias("row_idx")), [*model.by, token]).join(model.matrix("input"), [*model.by, "row_idx"]).select(*keys, "vec")
    grams = words.select(*keys, F.explode(ngram_buckets(F.col(token), m["min_n"], m["max_n"], m["ngram_buckets"], mode)).alias("row_idx"))
    return own.unionByName(grams.join(model.matrix("ngram"), [*model.by, "row_idx"]).select(*keys, "vec"))


def word_vectors(words: DataFrame, model: Model, token: str = "token", mode: str = "byte") -> DataFrame:
    """(token, vec) for each distinct word; one outside the vocabulary is the sum of its n-grams alone."""
    w = words.select(token).distinct()
    got = sum_vectors(word_rows(w, model, [token], token, mode), [token]).drop("n")
    return w.join(got, token, "left").select(token, F.coalesce("vec", zeros(model.meta["d_word"])).alias("vec"))


def projection(model: Model) -> DataFrame:
    """One row, or one for each replicate: W, the projection as an array of rows. Its size is d_out times the sum of three dimensions, whatever the corpus."""
    return model.matrix("W_proj").groupBy(*model.by).agg(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "vec"))), lambda s: s["vec"]).alias("W"))


def project_words(words: DataFrame, model: Model, token: str = "token", mode: str = "byte") -> DataFrame:
    """(token, vec): projected with zero groups and not normalised, so only the first d_word columns of the projection are read."""
    d = model.meta["d_word"]
    part = projection(model).select(F.transform("W", lambda r: F.slice(r, 1, d)).alias("W"))
    return word_vectors(words, model, token, mode).join(F.broadcast(part)).select(token, matvec(F.col("W"), F.col("vec")).alias("vec"))


def word_cache(model: Model, mode: str = "byte") -> DataFrame:
    """(idx, token, vec, norm): projected vectors of the vocabulary; a vector with a part that isn't finite becomes zero."""
    p = project_words(model.words().select("token"), model, mode=mode).withColumn("vec", finite_or_zero(F.col("vec")))
    return model.words().select("idx", "token").join(p, "token").select("idx", "token", "vec", norm(F.col("vec")).alias("norm"))


def combined(queries: DataFrame, model: Model, mode: str = "byte") -> DataFrame:
    """`queries` (qid, words, patient, encounter) with `vec`, of unit length unless it counts as zero; for an ensemble once for each replicate_id."""
    m = model.meta
    if model.replicates:
        queries = queries.withColumn("replicate_id", F.explode(F.array(*[F.lit(i) for i in model.replicates])))
    keys = [*model.by, "qid"]
    q = queries.select(*keys, "words", "patient", "encounter")
    words = q.select(*keys, F.explode("words").alias("token"))
    w = sum_vectors(word_rows(words, model, keys, mode=mode), keys).select(*keys, F.col("vec").alias("_w"))
    out = queries.join(w, keys, "left")
    total = F.greatest(F.size("words"), F.lit(1)).cast("double")
    parts = [F.coalesce(F.transform("_w", lambda x: x / total), zeros(m["d_word"]))]
    for g in ("patient", "encounter"):
        known = model.words(g).select(*model.by, "token", F.col("idx").alias("row_idx"))
        tokens = q.select(*keys, F.explode(g).alias("token")).join(known, [*model.by, "token"]).join(model.matrix(g), [*model.by, "row_idx"])
        s = sum_vectors(tokens.select(*keys, "vec"), keys).select(*keys, F.col("vec").alias(f"_{g}"), F.col("n").cast("double").alias(f"_n_{g}"))
        out = out.join(s, keys, "left")
        parts.append(F.coalesce(divide(F.col(f"_{g}"), F.col(f"_n_{g}")), zeros(m[f"d_{g}"])))
    w = F.broadcast(projection(model))  # of a fixed size for each replicate
    z = out.withColumn("_z", F.concat(*parts))
    z = z.join(w, model.by) if model.replicates else z.join(w)
    z = z.withColumn("vec", normalized(matvec(F.col("W"), F.col("_z"))))
    return z.select(*queries.columns, "vec")


def group_vector(queries: DataFrame, model: Model, groups: tuple[str, ...] = ("words", "patient", "encounter"), mode: str = "byte") -> DataFrame:
    """`combined` with only some of the groups; the others count as empty."""
    empty = F.array().cast("array<string>")
    return combined(queries.withColumns({g: F.col(g) if g in groups else empty for g in ("words", "patient", "encounter")}), model, mode)


def is_zero(vec: Column) -> Column:
    return norm(vec) < MIN_NORM


def block_norms(model: Model) -> DataFrame:
    """(block, norm): Frobenius norm of the projection's columns for each group, and of the whole."""
    m = model.meta
    a, b = m["d_word"], m["d_word"] + m["d_patient"]
    x = model.matrix("W_proj").select(F.posexplode("vec").alias("j", "x"))
    block = F.when(F.col("j") < a, "word").when(F.col("j") < b, "patient").otherwise("encounter")
    sq = x.groupBy(block.alias("block")).agg(F.sum(F.col("x").cast("double") * F.col("x")).alias("s"))
    return sq.select("block", F.sqrt("s").alias("norm")).unionByName(sq.agg(F.sqrt(F.sum("s")).alias("norm")).select(F.lit("all").alias("block"), "norm"))


def matrix_health(matrices: DataFrame) -> DataFrame:
    """(matrix, n_values, n_nan, n_inf) of every matrix, so that all bad ones show at once."""
    nan = F.size(F.filter("vec", lambda x: F.isnan(x)))
    inf = F.size(F.filter("vec", lambda x: F.abs(x.cast("double")) == float("inf")))
    return matrices.groupBy("matrix").agg(F.sum(F.size("vec")).alias("n_values"), F.sum(nan).cast("long").alias("n_nan"), F.sum(inf).cast("long").alias("n_inf"))
