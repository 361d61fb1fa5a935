"""Dense positions over a whole table, or within each of its groups, without a window that holds a table or a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covarium.session import materialize


#: Rows of a range are numbered below this many bits of `monotonically_increasing_id`, the range above.
_BITS = 33


def _ranges(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """`df` dealt by ranges of the order and written once, in order, with `_at`: the range and the place in it, so that nothing is shuffled again to be numbered."""
    return materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_part", F.shiftright("_at", _BITS))


def dense_index(df: DataFrame, order: list[Column], name: str = "idx", partitions: int | None = None) -> DataFrame:
    """`df` with `name` = 0, 1, 2, ... in the order given, which must be total.

    Rows are dealt out by ranges of the order; each range numbers its own rows, and only one count for each range meets in one task. The dealt rows are written once, which fixes the ranges;
    the ranges' bounds come from a sample of what the last shuffle below left, so nothing further down is computed for them again.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _ranges(df, n, order)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", before.alias("_before"))
    own = F.col("_at").bitwiseAND((1 << _BITS) - 1)
    return dealt.withColumn("_own", own).drop("_at").join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def segmented_index(df: DataFrame, keys: list[str], order: list[Column], name: str = "idx", partitions: int | None = None) -> DataFrame:
    """`df` with `name` = 0, 1, 2, ... within each value of `keys` (null is one) in the order given, which must be total within a group.

    Rows are dealt out by ranges of (keys, order), so a large group spans ranges; each range numbers its own rows of each group, and what precedes them is the sum of one count for each range that the group spans.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _ranges(df, n, [*map(F.col, keys), *order])
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")).withColumn("_before", before).drop("_n").toDF("_p", *[f"_k{i}" for i in range(len(keys))], "_first", "_before")
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return dealt.join(starts, same).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).select(*df.columns, name)
