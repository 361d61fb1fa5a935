"""Corpus assembly: every sentence once, or a two-stage bootstrap of patients and their notes, and a seeded shuffle.

All draws hash (seed, replicate, key), so results don't depend on partitions, any number of replicates comes out of one job, and a lost task draws the same again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.functions.hashing import portable_int
from covarium.operators.ranking import dense_index, segmented_index


def explode_sentences(table: DataFrame) -> DataFrame:
    """Every sentence once, with its position from 0."""
    # the outer form keeps the optimizer from testing the arrays' sizes first, which would compute them twice
    return table.select(*[c for c in table.columns if c != "Sentences"], F.posexplode_outer("Sentences").alias("pos", "sentence")).filter(F.col("pos").isNotNull())


def draw(n: Column, *keys: Column) -> Column:
    """A number from 0 to n - 1."""
    return portable_int(F.concat_ws("-", *[k.cast("string") for k in keys])) % n


def bootstrap_notes(notes: DataFrame, seed: int | None, patient: str, note: str, replicates: list[int] | None = None) -> DataFrame:
    """Stage one draws as many patients as there are, stage two, for each drawn patient, as many of the patient's notes as there are; both with replacement.

    Returns replicate_id, instance (which draw of stage one), draw (which of stage two), and the patient and note drawn. `replicates`: their seeds; replicate_id is the seed.
    Notes are numbered by ranges of (patient, note), so that one patient's notes may span tasks; patients by ranges. The text isn't touched: join it afterwards.
    """
    numbered = segmented_index(notes.select(patient, note), [patient], [F.col(note)], "_note")
    sizes = numbered.groupBy(patient).agg(F.count(F.lit(1)).alias("_n"))
    ranked = dense_index(sizes, [F.col(patient)], "_patient")
    n = ranked.count()
    reps = F.array(*[F.lit(r) for r in (replicates if replicates is not None else [seed])])
    instances = notes.sparkSession.range(n).select(F.col("id").alias("instance"), F.explode(reps).alias("replicate_id"))
    first = instances.withColumn("_patient", draw(F.lit(n), F.col("replicate_id"), F.col("instance")))
    chosen = first.join(ranked, "_patient").select("replicate_id", "instance", patient, "_n")
    second = chosen.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    second = second.withColumn("_note", draw(F.col("_n"), F.col("replicate_id"), F.col("instance"), F.col("draw")))
    return second.join(numbered, [patient, "_note"]).select("replicate_id", "instance", "draw", patient, note)


def expand(sample: DataFrame, table: DataFrame, patient: str = "SUBJECT_ID", note: str = "ROW_ID", near: list[str] | None = None) -> DataFrame:
    """All sentences of the drawn notes; a note drawn twice comes twice. `near`: columns by which a task sorts its notes first, so that rows which share long strings leave it one after the other and compress well when they are moved on."""
    drawn = sample.join(table, [patient, note])
    return explode_sentences(drawn.sortWithinPartitions(*near) if near else drawn)


def shuffle_key(seed: int | Column, *keys: Column) -> Column:
    """Sorting by this is a reproducible shuffle. Give `keys` that tell all rows apart."""
    first = F.concat(F.lit("shuffle-"), seed.cast("string")) if isinstance(seed, Column) else F.lit(f"shuffle-{seed}")
    return F.md5(F.concat_ws("-", first, *[k.cast("string") for k in keys]).cast("binary"))


def shuffled(df: DataFrame, seed: int, keys: list[str]) -> DataFrame:
    """Global order by the shuffle key: a range exchange, no single task."""
    return df.orderBy(shuffle_key(seed, *map(F.col, keys)), *keys)


def shuffle_seed(bootstrap_seed: int | None, given: int | None) -> int:
    """The shuffle's own seed, else the bootstrap's, else 42; its draws are salted, so both may be equal."""
    return given if given is not None else bootstrap_seed if bootstrap_seed is not None else 42
