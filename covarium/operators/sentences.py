"""Sentence tables from merged notes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from covarium.functions.text import MIN_SENTENCE, clean_sentence, clean_text, sentences, split_sentences
from covarium.operators.covariates import with_groups


def arrow_splitter(split: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """A trained or other external splitter (text -> sentences) as an Arrow function, for use in place of the rule."""

    @pandas_udf("array<string>")
    def run(texts):
        return texts.map(lambda t: list(split(t)) if t else [])

    return run


def sentence_table(merged: DataFrame, min_len: int = MIN_SENTENCE, splitter: Callable[[Column], Column] = split_sentences, ascii_only: bool = False) -> DataFrame:
    """SUBJECT_ID, ROW_ID, patient_group, encounter_group, Sentences; notes without a sentence go."""
    grouped = with_groups(merged)
    if splitter is split_sentences:
        s = sentences(F.col("TEXT"), min_len, ascii_only)
        out = grouped.withColumn("Sentences", s)
    else:  # an Arrow function stands alone in its projection
        pieces = grouped.withColumn("_pieces", splitter(clean_text(F.col("TEXT"), ascii_only)))
        out = pieces.withColumn("Sentences", F.filter(F.transform("_pieces", lambda x: clean_sentence(x, ascii_only)), lambda x: F.length(x) >= min_len))
    return out.filter(F.size("Sentences") > 0).select("SUBJECT_ID", "ROW_ID", "patient_group", "encounter_group", "Sentences")


def totals(table: DataFrame) -> DataFrame:
    """One row: n_patients, n_notes, n_sentences."""
    return table.agg(F.count_distinct("SUBJECT_ID").alias("n_patients"), F.count(F.lit(1)).alias("n_notes"), F.coalesce(F.sum(F.size("Sentences")), F.lit(0)).cast("bigint").alias("n_sentences"))
