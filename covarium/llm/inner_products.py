"""Exact top-k by inner product over integer vectors, longest vectors first, with rotated partial sums and Cauchy-Schwarz bounds.

Every component x becomes floor(scale * x). Candidates are dealt out by descending length into shards of bounded size; queries into groups of bounded size; a task takes one shard and one group, so a shard is read once
for each group and nothing unbounded meets in one place. Within a task candidates come in blocks, the longest first:

* a query leaves as soon as its length times the next candidate's is below its k-th best score so far;
* vectors are rotated by the eigenvectors of the Gram matrix of all vectors (the right singular vectors of the table), which puts most of an inner product into the first components. The sums over the first
  components are taken for all pairs of a block and more components only for the pairs that are left; a pair goes when its partial sum plus the product of what is left of both lengths is below the k-th best score;
* pairs that no bound rules out are scored exactly, as integers. Bounds have room for rounding, so no pair is lost by it, and equal scores are never cut.

Before that, all queries meet the `HEAD` longest vectors, which gives each a first k-th best score; shards whose longest vector can't reach it aren't sent the query at all.

Defined results: vectors that are null or hold null or non-finite components take no part; components that a shorter vector lacks count as zero; an empty vector scores zero. A query's own row is known by its id, so
rows of its id are no candidates; other rows that repeat an id are candidates of their own, a null id comes after all others and is never a query. Repeated rows of a query's id with equal vectors are answered once.
Fewer than k candidates are all returned; an empty table gives an empty result. Scores are exact while they and the squared lengths fit in 64 bits. Ids are whole numbers or null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covarium.llm.common import LAST_ID, give_back
from covarium.session import materialize, release, ship

SCALE, K, EVERY = 64, 20, 20
#: Longest vectors that give the first thresholds; rows of a shard, of a block within it, and of a group of queries.
HEAD, SHARD, BLOCK, GROUP = 4096, 1 << 15, 1024, 4096
#: Shares of the components after which partial sums are tested.
LEVELS = (0.125, 0.25, 0.5)
#: Share of a block's pairs up to which the pairs that are left are taken one by one.
SPARSE = 0.1
#: Room for rounding in a bound, as a share of the product of the lengths: far above what sums of doubles lose.
ROOM = 1e-9
LOWEST = -(1 << 63)


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, key, v, norm2): whole components of the vectors that take part; `key` is the id, LAST_ID for null."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale))
    sound = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    out = vectors.filter(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return out.select("id", F.coalesce("id", F.lit(LAST_ID)).alias("key"), "v", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x).alias("norm2"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column as one int64 matrix of d columns; shorter rows end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(column.offsets.to_numpy())
    if len(size) and (size == d).all():
        return flat.reshape(len(size), d)
    out = np.zeros((len(size), d), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Eigenvectors of the Gram matrix of all vectors, those of the largest eigenvalues first. Each task sends d rows of d numbers; any rotation gives right results, so sums of doubles will do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((d, d))
        for b in batches:
            x = matrix(b.column(0), d).astype(float)
            gram += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(d), d)), pa.array(np.tile(np.arange(d), d)), pa.array(gram.ravel())], names=["i", "j", "g"])

    gram = np.zeros((d, d))
    for r in vectors.select("v").mapInArrow(run, "i long, j long, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():  # d x d
        gram[r.i, r.j] = r.g
    values, basis = np.linalg.eigh(gram)
    return basis[:, np.argsort(-values)]


class Side:
    """Rows with what bounds need: integers, rotated components, and the length of what is left after each level."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, basis: np.ndarray):
        self.ids, self.v = ids, v
        self.turned = v.astype(float) @ basis
        self.edge = [0, *sorted({max(1, int(v.shape[1] * s)) for s in LEVELS} - {v.shape[1]}), v.shape[1]] if v.shape[1] else [0]
        square = self.turned * self.turned
        self.left = [np.sqrt(square[:, e:].sum(axis=1)) for e in self.edge]
        self.length = self.left[0]
        self.largest = float(np.abs(v).max(initial=0))

    def rows(self, at) -> Side:
        new = object.__new__(Side)
        new.ids, new.v, new.turned, new.edge = self.ids[at], self.v[at], self.turned[at], self.edge
        new.left = [x[at] for x in self.left]
        new.length, new.largest = new.left[0], self.largest
        return new


def exact(q: Side, c: Side, i: np.ndarray | None = None, j: np.ndarray | None = None) -> np.ndarray:
    """Integer inner products of all pairs, or of the pairs (i, j). Products of doubles are exact below 2**53."""
    small = q.largest * c.largest * max(1, q.v.shape[1]) < 2.0**53
    if i is not None:
        return np.einsum("nd,nd->n", q.v[i], c.v[j])
    if small:
        return (q.v.astype(float) @ c.v.astype(float).T).astype(np.int64)
    return q.v @ c.v.T


def survivors(q: Side, c: Side, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of all pairs that may reach floor, the k-th best scores so far."""
    room = ROOM * q.length[:, None] * c.length[None, :] + 1e-6
    need = floor[:, None] - room
    part = np.zeros((len(q.ids), len(c.ids)))
    pairs = None
    for level, (a, b) in enumerate(zip(q.edge, q.edge[1:]), 1):
        if level == len(q.edge) - 1:
            break
        if pairs is None:
            part += q.turned[:, a:b] @ c.turned[:, a:b].T
            alive = part + q.left[level][:, None] * c.left[level][None, :] >= need
            if alive.sum() <= SPARSE * alive.size:
                pairs = np.nonzero(alive)
                part, need = part[pairs], need[pairs]
        else:
            i, j = pairs
            part += np.einsum("nd,nd->n", q.turned[i, a:b], c.turned[j, a:b])
            alive = part + q.left[level][i] * c.left[level][j] >= need
            pairs, part, need = (i[alive], j[alive]), part[alive], need[alive]
    if pairs is None:
        score = exact(q, c)
        i, j = np.nonzero(score >= floor[:, None])
        return i, j, score[i, j]
    i, j = pairs
    score = exact(q, c, i, j)
    good = score >= floor[i]
    return i[good], j[good], score[good]


class Best:
    """The k best (score, id) of each query: higher scores first, then smaller ids. `floor` is the k-th best score, or what was known before."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.q, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(q):
            return
        q, ids, score = np.concatenate([self.q, q]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])
        keep = place < self.k
        self.q, self.id, self.score = q[keep], ids[keep], score[keep]


def against(q: Side, blocks: Iterator[Side], k: int, floor: np.ndarray) -> Best:
    """The best of the candidates in `blocks`, the longest first, for every query."""
    best = Best(len(q.ids), k, floor)
    for c in blocks:
        reach = q.length * c.length.max(initial=0.0)
        live = np.flatnonzero(reach + ROOM * reach + 1e-6 >= best.floor)
        for at in range(0, len(live), 512):
            rows = live[at : at + 512]
            i, j, score = survivors(q.rows(rows), c, best.floor[rows])
            other = q.ids[rows[i]] != c.ids[j]
            best.add(rows[i[other]], c.ids[j[other]], score[other])
    return best


def in_blocks(ids: np.ndarray, v: np.ndarray, basis: np.ndarray, size: int = BLOCK) -> Iterator[Side]:
    for at in range(0, len(ids), size):
        yield Side(ids[at : at + size], v[at : at + size], basis)


def _floors(queries: DataFrame, head: tuple[np.ndarray, np.ndarray], basis: np.ndarray, k: int) -> DataFrame:
    """`queries` with `floor`: a score that at least k of the longest candidates reach, the lowest number if there are fewer."""
    sent = queries.sparkSession.sparkContext.broadcast((head, basis))  # HEAD rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, v), basis = sent.value
        for b in batches:
            floors = []
            for at in range(0, b.num_rows, GROUP):
                part = b.slice(at, GROUP)
                q = Side(part.column(1).to_numpy(), matrix(part.column(2), len(basis)), basis)
                floors.append(against(q, in_blocks(ids, v, basis), k, np.full(len(q.ids), LOWEST)).floor)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(floors) if floors else [], pa.int64())], names=[*b.schema.names, "floor"])
        give_back()

    return queries.select("id", "key", "v", "norm2").mapInArrow(run, "id long, key long, v array<bigint>, norm2 long, floor long")


def _tasks(basis, k: int):
    """One task's rows come by (task, kind, norm2 descending): the queries of a group, then the candidates of a shard, the longest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mat = basis.value
        d = len(mat)
        task, q, held, best = None, None, [], None

        def out() -> Iterator[pa.RecordBatch]:
            if best is not None and len(best.q):
                yield pa.RecordBatch.from_arrays([pa.array(q.ids[best.q]), pa.array(number[best.q]), pa.array(best.id), pa.array(best.score)], names=["query_id", "query", "vec_id", "score"])

        for b in batches:
            names = b.column(0).to_numpy()
            kind = b.column(1).to_numpy()
            change = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (kind[1:] != kind[:-1])])) if len(names) else []
            for a, e in zip(change, [*change[1:], len(names)], strict=True) if len(names) else ():
                part = b.slice(a, e - a)
                ids, v = part.column(2).to_numpy(), matrix(part.column(3), d)
                if names[a] != task:
                    yield from out()
                    task, q, held, best = names[a], None, [], None
                if kind[a] == 0:
                    held.append((ids, v, part.column(4).to_numpy(), part.column(5).to_numpy()))
                    continue
                if held:
                    ids_, v_, floor, number = (np.concatenate(x) for x in zip(*held, strict=True))
                    q, held = Side(ids_, v_, mat), []
                    best = Best(len(ids_), k, floor)
                if q is not None:
                    got = against(q, in_blocks(ids, v, mat), k, best.floor)
                    best.floor = np.maximum(best.floor, got.floor)
                    best.add(got.q, got.id, got.score)
        yield from out()
        give_back()

    return run


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every row with `is_query` (on a column `id`) against all others."""
    spark = vectors.sparkSession
    ship(spark)
    rows = materialize(integers(vectors, id_col, vector_col, scale), "vectors")
    queries = rows.filter(F.col("id").isNotNull() & is_query).dropDuplicates(["id", "v"])
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    basis = rotation(rows, facts.d)
    longest = rows.orderBy(F.desc("norm2"), "key").limit(HEAD).select("key", "v").toArrow()
    head = (longest["key"].to_numpy(), matrix(longest["v"], facts.d))
    floors = materialize(_floors(queries, head, basis, k), "queries")
    asked = floors.count()
    groups = max(1, -(-asked // GROUP))
    shards = max(1, -(-facts.n // SHARD), min(spark.sparkContext.defaultParallelism, -(-facts.n // BLOCK)))
    dealt = materialize(rows.repartitionByRange(shards, F.desc("norm2"), "key").withColumn("shard", F.spark_partition_id()).select("shard", "key", "v", "norm2"), "shards")
    tops = dealt.groupBy("shard").agg(F.max("norm2").cast("double").alias("top")).agg(F.collect_list(F.struct("shard", "top")).alias("tops"))  # one row, an entry for each shard
    fits = F.filter("tops", lambda s: F.sqrt(s["top"] * F.col("norm2")) * (1 + 2 * ROOM) + 1e-6 >= F.col("floor"))
    number = F.xxhash64("key", "v")  # tells the rows of a repeated query id apart
    asks = floors.crossJoin(tops).select("key", "v", "floor", number.alias("query"), F.pmod(number, F.lit(groups)).alias("g"), F.explode(fits).alias("s"))
    task = lambda shard: (shard * groups + F.col("g")).alias("task")
    asks = asks.select(task(F.col("s.shard").cast("long")), F.lit(0).alias("kind"), "key", "v", "floor", "query", F.lit(0).cast("long").alias("norm2"))
    zero = F.lit(0).cast("long")
    offers = dealt.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).select(task(F.col("shard").cast("long")), F.lit(1).alias("kind"), "key", "v", zero.alias("floor"), zero.alias("query"), "norm2")
    met = asks.unionByName(offers).repartition(shards * groups, "task").sortWithinPartitions("task", "kind", F.desc("norm2"), "key")
    found = met.select("task", "kind", "key", "v", "floor", "query").mapInArrow(_tasks(spark.sparkContext.broadcast(basis), k), "query_id long, query long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    best = materialize(found.withColumn("rank", place).filter(F.col("rank") <= k), "best")
    release(rows, floors, dealt)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.expr(f"nullif(vec_id, {LAST_ID}L)").alias("vec_id"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % EVERY == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20
"""
