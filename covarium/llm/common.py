"""Shared parts of the training-data operators.

Words everywhere are maximal runs of characters other than U+0020 and U+0009..U+000D. `bytes.split()` splits on exactly
these six, so operators take the text as UTF-8 bytes and need no regular expression.

Columns that an operator adds replace columns of the input with the same name (in any case, as Spark resolves names), as `withColumn` does; so a result never has
two columns of one name because of an operator, and an operator can be applied to its own result.
"""

from __future__ import annotations

import contextlib
import ctypes
import weakref
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from covarium.session import ship

#: Rows and bytes that are turned into Python objects at a time. Spark's own batches may be larger; they are worked off in slices.
SLICE_ROWS = 1000
SLICE_BYTES = 4 << 20

WORD_RE = r"[^\x20\x09-\x0D]+"
#: Stands for a null id where ids are compared: after all others.
LAST_ID = (1 << 63) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def crc_fold(id_col: str, k: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(k)


def id_key(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))


def text_key(text_col: str = "text") -> Column:
    """With the id, what tells rows apart: rows with equal ids and texts are judged alike by every operator here."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def labelled(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, sample: int, values: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(doc_id, y, text) of the `sample` allowed labelled ids with the smallest hashes, whose label is one of `values`.

    The bounded top-k keeps `sample` rows a task and needs no window over a class. Repeated labels count once; of several texts with one id that with the smallest hash is taken, so the
    number of rows is bounded whatever repeats. Null texts count as empty.
    """
    use = labels.select("doc_id", F.col(label).alias("y")).filter(F.col("y").isin(*values)).filter(allowed).distinct()
    few = use.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")  # `sample` rows at most
    return texts.groupBy("doc_id", "y").agg(F.min_by("text", text_key()).alias("text"))


class WordCache(dict):
    """Results of `fn` for short words. Bounded by entries of bounded size, so by bytes: it is emptied when full, and longer words aren't remembered. A task that has no use for it empties it (`give_back`): a
    worker process outlives its task, and the next one's may be another operator's."""

    LONGEST, ENTRIES = 48, 1 << 18
    ALL: weakref.WeakSet[WordCache] = weakref.WeakSet()

    def __init__(self, fn: Callable):
        super().__init__()
        self.fn, self.used = fn, False
        self.ALL.add(self)

    __hash__ = object.__hash__

    def __missing__(self, word):
        self.used = True
        got = self.fn(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.ENTRIES:
                self.clear()
            self[word] = got
        return got


def give_back() -> None:
    """Return freed memory to the system, and that of caches that this task didn't fill: a worker process outlives its task, and what it keeps adds to the next one's."""
    for cache in list(WordCache.ALL):
        if not cache.used:
            cache.clear()
        cache.used = False
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batch: pa.RecordBatch, at: list[int]) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most SLICE_ROWS rows and, unless a single row has more, about SLICE_BYTES bytes in the columns `at`."""
    n, ends = batch.num_rows, None
    for i in at:
        c = batch.column(i)
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type):
            size = pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        elif pa.types.is_list(c.type):
            size = 16 * pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            continue
        ends = np.cumsum(size) if ends is None else ends + np.cumsum(size)
    lo = 0
    while lo < n:
        hi = min(n, lo + SLICE_ROWS)
        if ends is not None:
            before = ends[lo - 1] if lo else 0
            hi = min(hi, max(lo + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def added(names: list[str], new: list[str], drop: tuple[str, ...] = ()) -> list[int]:
    """Places of the columns `names` that stay when the columns `new` come."""
    gone = {n.lower() for n in new}
    return [i for i, n in enumerate(names) if n not in drop and n.lower() not in gone]


def append(df: DataFrame, inputs: list[str], fn: Callable[..., Iterable], schema: str | StructType, drop: tuple[str, ...] = (), args: tuple = ()) -> DataFrame:
    """The rows of `df`, without the columns in `drop` and those that are replaced, plus the columns of `schema`, computed by Arrow batches.

    `fn(*lists, *args)` gets one Python list for each of `inputs` (a string column as UTF-8 bytes, null as empty) and returns one sequence or Arrow
    array for each column of `schema`. Other columns pass through as Arrow arrays, untouched and under positional names, so any name may occur in `df`.
    Every row is handled alone or within its slice: no shuffle, and a task that is run again gives the same rows. No setting of the session is changed.
    """
    ship(df.sparkSession)
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    names = df.columns
    stay = added(names, [f.name for f in schema], drop)
    inner = df.select(*[F.col(f"`{n}`").alias(f"_c{i}") for i, n in enumerate(names)]) if len(set(names)) == len(names) else df.toDF(*[f"_c{i}" for i in range(len(names))])
    kind = StructType([*[StructField(f"_c{i}", inner.schema[i].dataType) for i in stay], *[StructField(f"_n{k}", f.dataType) for k, f in enumerate(schema)]])
    target = to_arrow_schema(kind)
    at = [names.index(n) for n in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, at):
                lists = []
                for i in at:
                    c = b.column(i)
                    if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
                        c = pc.fill_null(c, "").cast(pa.binary() if pa.types.is_string(c.type) else pa.large_binary())
                    lists.append(c.to_pylist())
                new = fn(*lists, *args)
                new = [c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(new, list(target)[len(stay) :], strict=True)]
                old = [b.column(i).cast(target.field(k).type) for k, i in enumerate(stay)]
                yield pa.RecordBatch.from_arrays([*old, *new], schema=target)
                del b, c, lists, new, old
        give_back()

    out = inner.mapInArrow(run, kind)
    return out.toDF(*[names[i] for i in stay], *[f.name for f in schema])
