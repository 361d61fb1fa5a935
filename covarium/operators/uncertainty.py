"""Bootstrap confidence intervals of similarities over an ensemble of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.functions.vectors import dot
from covarium.operators.compose import combined
from covarium.sources.model_store import Model, stacked


def label(words: Column, patient: Column, encounter: Column, first_word_only: bool = False) -> Column:
    """All words (or the first), the first patient token and the first encounter token, with a blank between; missing ones are empty."""
    first = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))
    return F.concat(first(words) if first_word_only else F.array_join(words, " "), F.lit(" "), first(patient), F.lit(" "), first(encounter))


def similarities(bases: DataFrame, targets: DataFrame) -> DataFrame:
    """(replicate_id, base, target, similarity) from vectors of both sides (replicate_id, qid, vec of unit length). Pairs meet only within a replicate, and both sides are query files."""
    b = bases.select("replicate_id", F.col("qid").alias("base"), F.col("vec").alias("_b"))
    t = targets.select("replicate_id", F.col("qid").alias("target"), F.col("vec").alias("_t"))
    return b.join(t, "replicate_id").select("replicate_id", "base", "target", dot(F.col("_b"), F.col("_t")).alias("similarity"))


def intervals(sims: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(base, target, similarity, lo, hi, n): the original's similarity (replicate 0) and exact percentiles, by linear interpolation, of the replicates'. Without replicates lo and hi are null.

    A pair has as many rows as the ensemble has replicates.
    """
    first = sims.filter(F.col("replicate_id") == 0).select("base", "target", "similarity")
    rest = sims.filter(F.col("replicate_id") > 0).groupBy("base", "target").agg(F.percentile(F.col("similarity").cast("double"), F.array(F.lit(low), F.lit(high))).alias("_p"), F.count(F.lit(1)).alias("n"))
    return first.join(rest, ["base", "target"], "left").select("base", "target", "similarity", F.element_at("_p", 1).alias("lo"), F.element_at("_p", 2).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def formatted(ci: DataFrame) -> DataFrame:
    """`ci` with `ci_text`: the interval to four places, `N/A` without replicates."""
    return ci.withColumn("ci_text", F.when(F.col("lo").isNull(), F.lit("N/A")).otherwise(F.format_string("[%.4f, %.4f]", "lo", "hi")))


def ensemble_intervals(models: Model | dict[int, Model], bases: DataFrame, targets: DataFrame) -> DataFrame:
    """Intervals for all pairs of base and target queries (qid, words, patient, encounter) over an ensemble, or models by replicate; bases vary slowest. Queries are composed once, by a plan keyed by the replicate."""
    model = stacked(models) if isinstance(models, dict) else models
    vectors = lambda q: combined(q, model).select("replicate_id", "qid", "vec")
    ci = formatted(intervals(similarities(vectors(bases), vectors(targets))))
    b = bases.select(F.col("qid").alias("base"), label(F.col("words"), F.col("patient"), F.col("encounter")).alias("base_label"))
    t = targets.select(F.col("qid").alias("target"), label(F.col("words"), F.col("patient"), F.col("encounter"), True).alias("target_label"))
    return ci.join(b, "base").join(t, "target").orderBy("base", "target")
