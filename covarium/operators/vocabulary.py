"""Token counts, vocabularies with dense indexes, and subsampling probabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.operators.ranking import dense_index

GROUPS = ("word", "patient", "encounter")


def token_counts(samples: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """(group_name, token, freq) over arrays of tokens, all groups in one aggregation. Groups are rows, so a fourth group is one more entry of `columns`."""
    columns = columns or {"word": "words", "patient": "patient", "encounter": "encounter"}

    def tagged(group: str, column: str) -> Column:
        return F.transform(F.col(column), lambda t: F.struct(F.lit(group).alias("group_name"), t.alias("token")))

    each = [tagged(g, c) for g, c in columns.items()]
    # the outer form keeps the optimizer from testing the arrays' sizes first, which would compute them twice
    return samples.select(F.explode_outer(F.concat(*each)).alias("t")).filter(F.col("t").isNotNull()).groupBy("t.group_name", "t.token").agg(F.count(F.lit(1)).alias("freq"))


def indexed(counts: DataFrame, threshold: int = 1, partitions: int | None = None) -> DataFrame:
    """(idx, token, freq): tokens of one group with at least `threshold` occurrences; the most frequent is 0, ties go by code point."""
    kept = counts.filter(F.col("freq") >= threshold).select("token", "freq")
    return dense_index(kept, [F.desc("freq"), F.asc("token")], partitions=partitions).select("idx", "token", "freq")


def vocabularies(counts: DataFrame, threshold: int = 5) -> dict[str, DataFrame]:
    """One vocabulary for each group; the threshold holds for words only."""
    return {g: indexed(counts.filter(F.col("group_name") == g), threshold if g == "word" else 1) for g in GROUPS}


def summary(counts: DataFrame, threshold: int = 5) -> DataFrame:
    """One row: unique, kept and dropped words, words' total of those kept, and group sizes."""
    is_word, enough = F.col("group_name") == "word", F.col("freq") >= threshold
    n = lambda c: F.count_if(c).alias
    return counts.agg(
        n(is_word)("unique_words"),
        n(is_word & enough)("kept_words"),
        n(is_word & ~enough)("dropped_words"),
        F.coalesce(F.sum(F.when(is_word & enough, F.col("freq"))), F.lit(0)).alias("kept_total"),
        n(F.col("group_name") == "patient")("patient_tokens"),
        n(F.col("group_name") == "encounter")("encounter_tokens"),
    )


def discard_prob(freq: Column, total: Column, t: float) -> Column:
    """Probability that an occurrence is skipped; `total` sums the words kept."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.sqrt(F.lit(t) * total / freq))


def with_discard(vocab: DataFrame, t: float = 1e-4) -> DataFrame:
    total = vocab.agg(F.sum("freq").cast("double").alias("_total"))
    return vocab.join(F.broadcast(total)).withColumn("discard_prob", discard_prob(F.col("freq"), F.col("_total"), t)).drop("_total")  # one row on the right


def stacked(vocabs: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [v.withColumn("group_name", F.lit(g)) for g, v in vocabs.items()])


def field_dump(vocab: DataFrame) -> DataFrame:
    """Tokens in code-point order."""
    return vocab.select("token").orderBy("token")


def lookup(tokens: DataFrame, vocab: DataFrame, token: str = "token") -> DataFrame:
    """`tokens` with `idx`, -1 for tokens outside the vocabulary."""
    v = vocab.select(F.col("token").alias(token), "idx")
    return tokens.join(v, token, "left").withColumn("idx", F.coalesce("idx", F.lit(-1)))


def reverse_lookup(indexes: DataFrame, vocab: DataFrame) -> DataFrame:
    """`indexes` with `token`, the empty string for an index out of range."""
    return indexes.join(vocab.select("idx", "token"), "idx", "left").withColumn("token", F.coalesce("token", F.lit("")))
