"""Incremental token counts over a growing corpus, with Structured Streaming. An extension: batch counting gives the same numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from covarium.operators.vocabulary import token_counts
from covarium.session import delete
from covarium.sources.corpus import counting_samples


def read_corpus(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def running_counts(lines: DataFrame) -> DataFrame:
    """(group_name, token, freq) of all lines seen so far. State is one row for each distinct token."""
    return token_counts(counting_samples(lines))


def start_counts(lines: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keeps the running counts in a memory table; for tests and exploration."""
    return running_counts(lines).writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: A base that holds the latest count of every token is written after so many triggers; older files go.
COMPACT_EVERY = 50


def start_counts_to_parquet(lines: DataFrame, path: str, checkpoint: str, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """After each trigger the tokens whose counts changed, and no others, are written under its number; `read_counts` takes each token's latest. A trigger that is repeated replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        if number % compact_every == compact_every - 1:
            compact(batch.sparkSession, path, number)

    return running_counts(lines).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that were written whole."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    whole = lambda s: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    return sorted(int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=") and whole(s))


def read_counts(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """(group_name, token, freq): each token's latest count, from the last base and the changes after it."""
    base = [n for n in _numbers(spark, f"{path}/base") if upto is None or n <= upto][-1:]
    later = [n for n in _numbers(spark, f"{path}/changes") if (not base or n > base[0]) and (upto is None or n <= upto)]
    folders = [f"{path}/base/batch={n}" for n in base] + [f"{path}/changes/batch={n}" for n in later]
    schema = "group_name string, token string, freq long"
    if not folders:
        return spark.createDataFrame([], schema)
    parts = spark.read.schema(schema).parquet(*folders)
    number = F.regexp_extract(F.input_file_name(), r"/batch=(\d+)/", 1).cast("long")
    return parts.withColumn("n", number).groupBy("group_name", "token").agg(F.max_by("freq", "n").alias("freq"))


def compact(spark: SparkSession, path: str, number: int) -> None:
    """Writes the counts after batch `number` as a base; then what it replaces is deleted. Repeating it writes the same."""
    read_counts(spark, path, number).write.mode("overwrite").parquet(f"{path}/base/batch={number}")
    for kind in ("changes", "base"):
        for n in _numbers(spark, f"{path}/{kind}"):
            if n < number or (kind == "changes" and n == number):
                delete(spark, f"{path}/{kind}/batch={n}")
