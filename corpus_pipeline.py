"""A training-data pipeline over `documents`, as five stages of the operators in covarium.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's docs. All but the last return
the columns of documents.

1. quality_rules: documents that the production policy rejects go.
2. simhash_near_dedup: of each component of documents whose five-word shingles have a Jaccard similarity of 0.8 or more one stays, that with the smallest id.
3. substring_dedup: words in passages of 50 words that also start in a document with a smaller id go; documents left without a word go.
4. source_mixing: each document comes as often (0, 1 or 2 times) as the mix of its source takes it.
5. bpe: token ids of every text, their number, and the text that they decode to compared with the text.

Null texts are rejected by the first stage as texts without words; empty tables pass through all stages empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covarium.llm import bpe, mixing, nearcopy, rules, substring
from covarium.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.filter_documents(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopy.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.clean_documents(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    both = bpe.round_trip(docs.select("doc_id", "source", "lang", "text"))
    return both.select("doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("bpe", bpe_encode),
]

#: BPE merges can't be stated in SQL; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
