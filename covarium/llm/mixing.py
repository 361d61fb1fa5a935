"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit number from its id. A source takes each document `whole` times and those below a threshold once more. The threshold that meets the
source's budget is found without sorting: words are summed by source and the first 12 bits of the number, the cumulative sums of these at most 4096 buckets
show the bucket in which the budget ends, and only that bucket is summed again by its next 12 bits, down to single documents. The last document is taken if that
brings the source nearer to its target, so a source misses its target by at most half a document.

Targets: sources in the order of their code points, null last, weigh 5, 2, 1 and so on again; together they get `share` of all words; a target stops at `cap`
times its source's size and the excess goes to the others by weight until none is above. That fixed point is min(cap * size, level * weight) with one level
for all, found by repeated sums over the table of sources.

Hot sources: sums are combined before the shuffle, refined rows are dealt by source and bucket, and thresholds reach the rows by a broadcast join only while there are at most
`BROADCAST_SOURCES` of them, else by a join salted with bits of the number.

Defined results: a null text has size 0; a null source is a source of its own; documents of size 0 take nothing; rows repeated with one id (or without
id, with one text) share one number and are taken or left together; equal numbers likewise; empty tables give empty results; extra columns pass through `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covarium.llm.common import append, text_key
from covarium.session import materialize

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
LEVEL_BITS, LEVELS = 12, 5
BROADCAST_SOURCES = 10_000
SALTS = 32


def number(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A 60-bit number that depends on the id alone; where that is null, on the text, so that rows without ids don't share one number."""
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text-"), text_key(text_col).cast("string")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def _sizes(texts: list[bytes]) -> list[list[int]]:
    return [[len(t.split()) for t in texts]]


def _prefix(h: Column, level: int) -> Column:
    """The first `level` groups of bits."""
    return F.shiftright(h, LEVEL_BITS * (LEVELS - level))


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their place in code-point order, null last, by ranges: one count for each range is all that meets in one task."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(sources.repartitionByRange(n, "none", "name").withColumn("part", F.spark_partition_id()), "sources")
    own = F.row_number().over(Window.partitionBy("part").orderBy("none", "name"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("before"))
    return dealt.withColumn("own", own).join(starts, "part").withColumn("place", F.col("before") + F.col("own") - 1).drop("part", "own", "before")


def targets(sources: DataFrame, share: float = SHARE, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(none, name, source_size) with weight and target; `none` marks the null source."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    s = materialize(_ranked(sources).withColumn("weight", weight).drop("place"), "ranked")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = F.lit(cap) * F.col("source_size") <= F.lit(level) * F.col("weight")
        got = s.agg(F.sum(over.cast("long")), F.sum(F.when(over, F.lit(cap) * F.col("source_size")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if not got[2] or got[0] == full:
            break
        full, level = got[0], (share * total - got[1]) / got[2]
    return s.withColumn("target", F.least((F.lit(cap) * F.col("source_size")).cast("double"), F.lit(level) * F.col("weight")))


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(none, name, below): the number below which a document of the source is taken once more. rows: none, name, size, h; wanted: none, name, need."""
    key = ["none", "name"]
    state = wanted.filter("need > 0").select(*key, "need", F.lit(0).cast("double").alias("base"), F.lit(0).cast("long").alias("at"))
    live = rows.filter("size > 0")
    for level in range(1, LEVELS + 1):
        if level > 1:
            live = live.withColumn("at", _prefix(F.col("h"), level - 1)).join(state.select(*key, "at"), [*key, "at"], "left_semi").drop("at")
        sums = live.groupBy(*key, _prefix(F.col("h"), level).alias("bucket")).agg(F.sum("size").alias("words"))
        w = Window.partitionBy(*key).orderBy("bucket")
        cum = sums.join(state.select(*key, "need", "base"), key).withColumn("upto", F.col("base") + F.sum("words").over(w))
        cum = cum.withColumn("last", F.lead("bucket").over(w).isNull())
        hit = cum.filter("(upto >= need AND upto - words < need) OR (last AND upto < need)").withColumn("rank", F.row_number().over(w)).filter("rank = 1")
        state = materialize(hit.select(*key, "need", (F.col("upto") - F.col("words")).alias("base"), F.col("bucket").alias("at"), "upto"), "bounds")
        if level < LEVELS:
            state = state.drop("upto")
            live = materialize(live.withColumn("at", _prefix(F.col("h"), level)).join(state.select(*key, "at"), [*key, "at"], "left_semi").drop("at"), "boundary") if level == 1 else live
    last = (F.col("upto") <= F.col("need")) | (F.col("upto") - F.col("need") < F.col("need") - F.col("base"))
    return state.select(*key, F.when(last, F.col("at") + 1).otherwise(F.col("at")).alias("below"))


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): rows has doc_id, none, name, size, h; sources has one row for each source with source_size, weight, target, whole and below."""
    keyed = docs.select("doc_id", F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), number().alias("h"), "text")
    rows = materialize(append(keyed, ["text"], _sizes, "size long", drop=("text",)), "sizes")
    sources = rows.groupBy("none", "name").agg(F.sum("size").alias("source_size"))
    t = targets(sources).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = materialize(t.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    below = thresholds(rows, t.select("none", "name", "need"))
    done = materialize(t.join(below, ["none", "name"], "left").withColumn("below", F.coalesce("below", F.lit(0))), "thresholds")
    return rows, done


def with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows (none, name, h, ...) with the columns of their source."""
    if sources.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources), ["none", "name"])
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", (F.col("h") % SALTS).cast("int")).join(salted, ["none", "name", "salt"]).drop("salt")


def copies() -> Column:
    return F.col("whole") + (F.col("h") < F.col("below")).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each row of `docs` as often as the mix takes it, none of it where the mix leaves it out."""
    _, sources = plan(docs)
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), number().alias("h"))
    taken = with_sources(rows, sources.select("none", "name", "whole", "below")).withColumn("n", copies()).filter("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select(*[F.col("row").getField(c).alias(c) for c in names])


def query(spark, sf_dir: str) -> DataFrame:
    from covarium.llm.common import documents

    rows, sources = plan(documents(spark, sf_dir))
    out = with_sources(rows, sources.select("none", "name", "source_size", "target", "whole", "below"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k,
         coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_words,
         sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open_weight,
         sum(source_size) OVER ()::BIGINT AS total FROM s
), lv AS (
  SELECT arg_min((1.5::DOUBLE * total - full_words) / open_weight, k) AS level FROM o
  WHERE (1.5::DOUBLE * total - full_words) / open_weight * weight < 2 * source_size
), t AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, coalesce(level, 0) * weight) AS target FROM s LEFT JOIN lv ON true
), n AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
), u AS (
  SELECT d.doc_id, d.source, d.size, d.h, n.source_size, n.target, n.whole, n.target - n.whole * n.source_size AS need,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h)::BIGINT AS own
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN need > 0 AND (upto <= need OR (upto - own < need AND upto - need < need - (upto - own))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM u
"""
