"""Nearest neighbours and pair comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from covarium.functions.vectors import MIN_NORM, cosine, dot, euclid, norm, similarity_label
from covarium.session import ship

#: Candidates of one matrix product, and of one task.
BLOCK_ROWS, PART_ROWS = 4096, 1 << 17
#: Bytes of query vectors that a task holds at most, more or less; more queries are dealt out into groups.
QUERY_BYTES = 64 << 20
#: Similarities that lie closer than this to a task's k-th best are all kept until they are computed exactly.
SLACK = 1e-9


def _exact(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise dot products, each in one order of additions whatever the block, so that equal vectors tie."""
    return (c * q).sum(axis=1)


class Best:
    """The k best candidates of every query so far, in one task: arrays of (query, similarity, idx, token)."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.q, self.sim, self.idx, self.token = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, q: np.ndarray, vec: np.ndarray, idx: np.ndarray, token: np.ndarray) -> None:
        """q, vec: unit vectors. One matrix product finds which pairs can be among the best; only these are computed exactly."""
        rough = vec @ q.T
        k = min(self.k, len(vec))
        kth = np.maximum(np.partition(rough, len(vec) - k, axis=0)[len(vec) - k], self.least)
        at, of = np.nonzero(rough >= kth - SLACK)
        found = (of, _exact(vec[at], q[of]), idx[at], token[at])
        of, sim, idx, token = (np.concatenate(x) for x in zip((self.q, self.sim, self.idx, self.token), found, strict=True))
        order = np.lexsort((idx, -sim, of))
        of = of[order]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        place = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
        keep = order[place < self.k]
        self.least[of[place == self.k - 1]] = sim[order[place == self.k - 1]]
        self.q, self.sim, self.idx, self.token = of[place < self.k], sim[keep], idx[keep], token[keep]


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """(qid, rank, idx, token, similarity): the k most similar candidates (idx, token, vec, norm) of each query (qid, vec), smaller idx first among equals.

    Exhaustive, as candidates meet every query, in blocks of both: a task takes one part of the candidates and one group of the queries, of bounded sizes; a block of its candidates times its queries is one matrix
    product, it keeps the k best for each query, and only these are shuffled and ranked. Nothing passes through the driver. A query or candidate that counts as zero gives nothing; a query's own words may be among its
    results; k below 1 counts as 1.
    """
    k = max(1, k)
    spark = queries.sparkSession
    ship(spark)
    live = queries.select("qid", F.transform("vec", lambda x: x.cast("double")).alias("vec"), norm(F.col("vec")).alias("n")).filter(F.col("n") >= MIN_NORM)
    cand = candidates.filter(F.col("norm") >= MIN_NORM).select("idx", "token", F.transform("vec", lambda x: x.cast("double")).alias("vec"), F.col("norm").alias("n"))
    kind = queries.schema["qid"].dataType.simpleString()
    count = lambda df, i, width: df.agg(F.lit(i).alias("side"), F.count(F.lit(1)).alias("n"), width.alias("d"))
    size = {r.side: r for r in count(live, 0, F.max(F.size("vec"))).unionByName(count(cand, 1, F.lit(0))).collect()}
    groups = max(1, -(-size[0].n * 8 * (size[0].d or 1) // QUERY_BYTES))
    parts = max(1, -(-size[1].n // PART_ROWS), min(spark.sparkContext.defaultParallelism, -(-size[1].n // BLOCK_ROWS)))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    task = (F.col("part") * groups + F.col("g")).alias("task")
    none = lambda t: F.lit(None).cast(t)
    asked = live.select("*", F.pmod(F.xxhash64("qid"), F.lit(groups)).alias("g"), numbers(parts).alias("part")).select(task, F.lit(0).alias("kind"), "qid", none("long").alias("idx"), none("string").alias("token"), "vec", "n")
    offered = cand.select("*", F.pmod(F.xxhash64("idx"), F.lit(parts)).alias("part"), numbers(groups).alias("g")).select(task, F.lit(1).alias("kind"), none(kind).alias("qid"), "idx", "token", "vec", "n")
    schema = f"qid {kind}, idx long, token string, similarity double"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, qid, held, q, best = None, [], [], None, None

        def out() -> Iterator[pa.RecordBatch]:
            if best is not None and len(best.q):
                yield pa.RecordBatch.from_arrays([pa.array([qid[i] for i in best.q.tolist()], target[0].type), pa.array(best.idx), pa.array(best.token, pa.string()), pa.array(best.sim)], schema=target)

        for b in batches:
            number, sort = (b.column(i).to_numpy() for i in (0, 1))
            cuts = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (sort[1:] != sort[:-1]), [True]])) if len(number) else [0]
            for a, e in zip(cuts, cuts[1:]):
                if number[a] != now:
                    yield from out()
                    now, qid, held, q, best = number[a], [], [], None, None
                if sort[a] == 0:
                    s = b.slice(a, e - a)
                    qid += s.column(2).to_pylist()
                    held.append(_matrix(s.column(5)) / s.column(6).to_numpy()[:, None])
                    continue
                if held:
                    q, held = np.concatenate(held), []
                    best = Best(len(q), k)
                for at in range(a, e if q is not None else a, BLOCK_ROWS):
                    s = b.slice(at, min(BLOCK_ROWS, e - at))
                    best.add(q, _matrix(s.column(5)) / s.column(6).to_numpy()[:, None], s.column(3).to_numpy(), np.array(s.column(4).to_pylist(), object))
        yield from out()

    met = asked.unionByName(offered).repartition(parts * groups, "task").sortWithinPartitions("task", "kind")
    w = Window.partitionBy("qid").orderBy(F.desc("similarity"), "idx")
    return met.mapInArrow(search, schema).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("qid", "rank", "idx", "token", "similarity")


def _matrix(c) -> np.ndarray:
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def nearest_one(query_vec: list[float], candidates: DataFrame, k: int = 10) -> DataFrame:
    """The same for one vector, as a bounded top-k that is merged from the tasks' own."""
    k = max(1, k)
    q = F.lit([float(x) for x in query_vec])
    n = sum(x * x for x in query_vec) ** 0.5
    if n < MIN_NORM:
        return candidates.limit(0).select("idx", "token", F.lit(0.0).alias("similarity"))
    s = candidates.filter(F.col("norm") >= MIN_NORM).select("idx", "token", (dot(F.col("vec"), q) / (F.col("norm") * F.lit(n))).alias("similarity"))
    return s.orderBy(F.desc("similarity"), "idx").limit(k)


def compare(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`pairs` with cosine, distance, euclid and label; null where a vector counts as zero."""
    cos = cosine(F.col(a), F.col(b))
    out = pairs.withColumn("cosine", cos)
    ok = F.col("cosine").isNotNull()
    return out.withColumns({"distance": 1 - F.col("cosine"), "euclid": F.when(ok, euclid(F.col(a), F.col(b))), "label": F.when(ok, similarity_label(F.col("cosine")))})
