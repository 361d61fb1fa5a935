"""Importance resampling towards a target distribution, with exact ranks from a histogram of integer scores.

Features are runs of 1 to `n` consecutive words (A-Z lower-cased; words are runs of ASCII digits, letters and characters beyond ASCII), joined by one space, repeats counted. A feature's bucket is the crc32 of
its UTF-8 bytes modulo `buckets`. One pass counts the buckets of the target's and of the source's texts; each task sends one row for a bucket at most, and the table of gains has one entry for a bucket, whatever the
data's size. A second pass scores every text by looking its buckets up in the array of gains. A seeded Gumbel draw, a hash of seed and id, makes the highest scores a sample without replacement.

Selection sorts nothing but ties. Scores are integers of a bounded range, so their histogram is small; its suffix sums say how many rows stand above each score, and the lowest score with fewer than k rows above
it is the cutoff. Rows above the cutoff are numbered by row_number over (score, range of ids) by id; what precedes such a cell is known from counts. No window holds more than 2**ID_RANGE ids of one score.

Defined results: null and empty texts have no features and weight 0; a null id draws as an empty one and comes after all others, by the hash of its text; repeated rows are each ranked, one after the other, in any
order; fewer eligible rows than k are all drawn; an empty table gives an empty result, an empty target gives gains from the source alone. Ids are whole numbers or null. Columns that the operator adds replace those
of the same name.
"""

from __future__ import annotations

from functools import lru_cache
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covarium.llm.common import LAST_ID, WordCache, append, documents, give_back, text_key
from covarium.llm.terms import cut
from covarium.session import materialize, ship, spread

N_GRAM, BUCKETS, SEED, SHARE, LEAST_WORDS = 1, 10_000, 2024, 10, 20
#: A cell of the numbering has 2**ID_RANGE ids.
ID_RANGE = 20


@lru_cache(2)
def _hashes(buckets: int) -> WordCache:
    return WordCache(lambda w: crc32(w) % buckets)


def features(text: bytes, n: int, buckets: int) -> tuple[int, np.ndarray]:
    """(words, buckets of all features)."""
    words, of = cut(text), _hashes(buckets)
    found = [of[w] for w in words]
    for k in range(2, n + 1):
        found += [crc32(b" ".join(words[i : i + k])) % buckets for i in range(len(words) - k + 1)]
    return len(words), np.array(found, np.int64)


def bucket_counts(texts: DataFrame, text_col: str = "text", n: int = N_GRAM, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts: at most one row for each bucket and task is shuffled."""
    import pyarrow as pa

    ship(texts.sparkSession)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                t = b.column(0)[i].as_py()
                if t:
                    total += np.bincount(features(t.encode(), n, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])
        give_back()

    counts = spread(texts.select(text_col)).mapInArrow(run, "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, text_col: str = "text", n: int = N_GRAM, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: 1000 times the log of its share of the target over its share of the source, both with one added to each bucket; floored."""
    counts = [bucket_counts(x, text_col, n, buckets).select(F.lit(i).alias("side"), "bucket", "n") for i, x in enumerate((source, target))]
    total = np.zeros((2, buckets), np.int64)
    for r in counts[0].unionByName(counts[1]).collect():  # at most two rows for each bucket
        total[r.side, r.bucket] = r.n
    (s, t), (all_s, all_t) = total, total.sum(axis=1)
    ratio = (t + 1.0) * float(all_s + buckets) / ((s + 1.0) * float(all_t + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _score(texts: list[bytes], sent, n: int, buckets: int) -> list[list[int]]:
    gain = sent.value
    out: list[list[int]] = [[], [], []]
    for t in texts:
        words, found = features(t, n, buckets)
        for column, v in zip(out, (words, len(found), int(gain[found].sum()) // len(found) if len(found) else 0), strict=True):
            column.append(v)
    return out


def noise(id_col: str = "doc_id", seed: int = SEED) -> Column:
    """A Gumbel draw in thousandths, floored: a hash of seed and id, so it depends on nothing else."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = N_GRAM, buckets: int = BUCKETS, seed: int = SEED, drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with n_words, n_features, weight (floored mean gain) and score (weight and noise)."""
    sent = docs.sparkSession.sparkContext.broadcast(gains(docs, target, text_col, n, buckets))  # one number for each bucket
    return append(spread(docs), [text_col], _score, "n_words long, n_features long, weight long", drop=drop, args=(sent, n, buckets)).withColumn("score", F.col("weight") + noise(id_col, seed))


def draw(scored: DataFrame, k: Column, eligible: Column, id_key: Column, tie: Column) -> DataFrame:
    """`scored` (a written table) with `rank`: 1, 2, ... for the k highest scores among the eligible rows, equal scores by `id_key` (a long, LAST_ID where there is none), then `tie` (a 64-bit hash); null for other
    rows. `k` is of the number N of eligible rows. What is counted, by score and by cell, is combined before it is shuffled.
    """
    cell = F.when(id_key < LAST_ID, F.shiftright(id_key, ID_RANGE)).otherwise(F.shiftright(tie, 44) + (1 << 44))
    rows = scored.withColumns({"_ok": F.coalesce(eligible, F.lit(False)), "_cell": cell})
    able = rows.filter("_ok")
    histogram = able.groupBy("score").agg(F.count(F.lit(1)).alias("_n"))  # bounded by the range of scores
    size = histogram.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("N")).select(F.floor(k).alias("_k"))
    above = F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = histogram.withColumn("_above", above).crossJoin(size).filter("_above < _k").drop("_n")  # one row on the right
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("score").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = able.groupBy("score", "_cell").agg(F.count(F.lit(1)).alias("_n")).join(offsets, "score").select("score", "_cell", "_k", (F.col("_above") + earlier).alias("_start"))
    found = able.join(cells, ["score", "_cell"], "left")
    own = F.row_number().over(Window.partitionBy("score", "_cell").orderBy(id_key, tie))
    drawn = found.filter("_start is not null").withColumn("rank", F.col("_start") + own).withColumn("rank", F.when(F.col("rank") <= F.col("_k"), F.col("rank")).cast("long"))
    none = F.lit(None).cast("long")
    out = [*scored.columns, "rank"]
    rest = found.filter("_start is null").withColumn("rank", none).select(*out).unionByName(rows.filter("not _ok").withColumn("rank", none).select(*out))
    return drawn.select(*out).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST_WORDS, text_col: str = "text", id_col: str = "doc_id", n: int = N_GRAM, buckets: int = BUCKETS, seed: int = SEED, keep_text: bool = False) -> DataFrame:
    """Every row of `docs` (its text too with `keep_text`) with n_words, n_features, weight, score, and rank where it is among the floor(share * N / 100) drawn of the N rows with at least `least` words."""
    keyed = docs.withColumn("_tie", text_key(text_col))
    scored = materialize(weigh(keyed, target, text_col, id_col, n, buckets, seed, drop=() if keep_text else (text_col,)).drop("rank"), "scores")
    return draw(scored, F.col("N") * share / 100, F.col("n_words") >= least, F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), F.col("_tie")).drop("_tie")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: The crc32 is stated by its polynomial: a table of 256 entries, then one step for each byte.
SQL = r"""
WITH cut AS (
  SELECT 0 AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
found AS (SELECT side, doc_id, word, count(*) AS n FROM (SELECT side, doc_id, unnest(words) AS word FROM cut) GROUP BY ALL),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)), lambda c, x: xor(step[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM found), steps),
counted AS (SELECT bucket, sum(CASE WHEN side = 0 THEN n ELSE 0 END)::BIGINT AS s, sum(CASE WHEN side = 1 THEN n ELSE 0 END)::BIGINT AS t FROM found JOIN hashed USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counted, (SELECT sum(s)::BIGINT AS all_s, sum(t)::BIGINT AS all_t FROM counted) AS totals),
weights AS (SELECT doc_id, sum(n * gain)::BIGINT AS total, sum(n)::BIGINT AS n FROM found JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (
  SELECT c.doc_id, len(words)::BIGINT AS n_features, coalesce((total - ((total % w.n) + w.n) % w.n) // w.n, 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || c.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM cut c LEFT JOIN weights w ON w.doc_id = c.doc_id WHERE side = 0),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER () AS size FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, weight + noise AS score, CASE WHEN r <= 10 * size // 100 THEN r END AS rank
FROM scored s LEFT JOIN ranked USING (doc_id)
"""
