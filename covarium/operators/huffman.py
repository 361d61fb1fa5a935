"""Huffman codes over a vocabulary, by classes of equal frequency.

The merge is sequential, but words of one frequency are merged alike: pairs of equal nodes are merged as a run, and the runs of leaves and of inner nodes are two queues. There are at most about as many frequencies as
the square root of twice the number of tokens, so the driver holds a few numbers for each frequency and none for a word; `MAX_BYTES` checks it before anything is gathered. A run's nodes have consecutive numbers, so a
parent follows from a node's place in its run, and tasks expand codes for their own words by climbing from run to run.

The order is that of the plain merge: the rarest leaf (of equal ones that with the greatest index) and the oldest inner node are compared, a leaf wins a tie, and the node taken second gets bit 1.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covarium.session import ship

#: Bytes that the runs of a tree may take on the driver, and those that one frequency may take there.
MAX_BYTES, CLASS_BYTES = 1 << 30, 512


@dataclass
class Runs:
    """Nodes of one kind by rising weight, in runs. A run begins at `low`; its node at place x has parent first + (x - low + bit) // 2 and bit (x - low + bit) % 2."""

    low: np.ndarray
    first: np.ndarray
    bit: np.ndarray

    def up(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.low, x, side="right") - 1
        q = x - self.low[k] + self.bit[k]
        return self.first[k] + q // 2, q % 2


@dataclass
class Tree:
    """Leaves are counted from the rarest, inner nodes in the order of their making; the root is the last."""

    words: int
    leaves: Runs
    inner: Runs

    def codes(self, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, code, path) of these words, from the root down, one word after the other; a path holds inner nodes' numbers."""
        steps, depth = [], np.zeros(len(idx), np.int64)
        live, at = np.arange(len(idx) if self.words > 1 else 0), self.words - 1 - np.asarray(idx, np.int64)
        runs = self.leaves
        while len(live):
            at, bit = runs.up(at[: len(live)])
            steps.append((live, bit, at))
            depth[live] += 1
            below = at < self.words - 2
            live, at, runs = live[below], at[below], self.inner
        start = np.zeros(len(idx) + 1, np.int64)
        np.cumsum(depth, out=start[1:])
        code, path = np.zeros(start[-1], np.int32), np.zeros(start[-1], np.int32)
        for k, (who, bit, node) in enumerate(steps, 1):
            code[start[who + 1] - k], path[start[who + 1] - k] = bit, node
        return start, code, path


def tree(freqs: np.ndarray, counts: np.ndarray) -> Tree:
    """`freqs`: rising frequencies, each once; `counts`: how many words have each."""
    leaves, inner = deque(map(list, zip(freqs.tolist(), counts.tolist(), strict=True))), deque()
    taken: tuple[list, list] = ([], [])  # (low, first, bit) of leaves, of inner nodes
    used, made = [0, 0], 0

    def front() -> int:
        return 0 if leaves and (not inner or leaves[0][0] <= inner[0][0]) else 1

    def take(kind: int, n: int, bit: int) -> int:
        queue = (leaves, inner)[kind]
        weight = queue[0][0]
        taken[kind].append((used[kind], made, bit))
        used[kind] += n
        queue[0][1] -= n
        if not queue[0][1]:
            queue.popleft()
        return weight

    words = int(counts.sum())
    while made < words - 1:
        kind = front()
        n = (leaves, inner)[kind][0][1] // 2
        if n:
            weight = 2 * take(kind, 2 * n, 0)
        else:
            n = 1
            weight = take(kind, 1, 0)
            weight += take(front(), 1, 1)
        if inner and inner[-1][0] == weight:
            inner[-1][1] += n
        else:
            inner.append([weight, n])
        made += n
    runs = [Runs(*(np.array([r[i] for r in t], np.int64) for i in range(3))) for t in taken]
    return Tree(words, *runs)


@dataclass
class Codes:
    """Codes and paths of all words from the root down, one word after the other; word i has start[i]..start[i + 1] - 1. A path holds inner nodes' numbers, the root being V-2. A single word has neither."""

    start: np.ndarray
    code: np.ndarray
    path: np.ndarray

    def __iter__(self) -> Iterator[tuple[list[int], list[int]]]:
        return map(self.of, range(len(self.start) - 1))

    def of(self, i: int) -> tuple[list[int], list[int]]:
        a, b = self.start[i], self.start[i + 1]
        return self.code[a:b].tolist(), self.path[a:b].tolist()


def codes(freqs: np.ndarray) -> Codes:
    """Codes of words given by falling frequency, for vocabularies that fit one machine."""
    values, counts = np.unique(np.asarray(freqs, np.int64), return_counts=True)
    return Codes(*tree(values, counts).codes(np.arange(len(freqs))))


def least_weighted_length(freqs) -> int:
    """Weighted path length of any optimal code; doesn't depend on how ties are broken."""
    heap = [int(f) for f in freqs]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        total += s
        heapq.heappush(heap, s)
    return total


def _lists(start: np.ndarray, flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(flat, pa.int32()))


def with_codes(vocab: DataFrame) -> DataFrame:
    """`vocab` (idx, token, freq; idx by falling frequency) with code and path. Only one row for each frequency reaches the driver, and words aren't shuffled."""
    spark = vocab.sparkSession
    classes = vocab.groupBy("freq").agg(F.count(F.lit(1)).alias("n"))
    most = MAX_BYTES // CLASS_BYTES
    rows = classes.orderBy("freq").limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"more than {most} different frequencies: raise the vocabulary's threshold, the tree may take {MAX_BYTES} bytes")
    ship(spark)
    sent = spark.sparkContext.broadcast(tree(rows["freq"].to_numpy(), rows["n"].to_numpy()))  # bounded by MAX_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, code, path = sent.value.codes(b.column("idx").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(start, code), _lists(start, path)], names=[*b.schema.names, "code", "path"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vocab.schema)
    return vocab.mapInArrow(run, f"{kinds}, code array<int>, path array<int>")


def depth_stats(coded: DataFrame) -> DataFrame:
    """One row: words, least, greatest and (whole-number) mean depth, words without a code, weighted length."""
    d = F.size("path")
    return coded.agg(
        F.count(F.lit(1)).alias("words"), F.min(d).alias("min_depth"), F.max(d).alias("max_depth"), F.expr("sum(size(path)) div count(1)").alias("avg_depth"), F.count_if(d == 0).alias("zero_depth"), F.sum(d * F.col("freq")).alias("weighted_length")
    )
