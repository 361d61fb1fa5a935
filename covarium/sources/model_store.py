"""Models as tables: Parquet folders, the little-endian binary file of native tools, and ensembles of replicates."""

from __future__ import annotations

import atexit
import contextlib
import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from covarium.session import checkpoint_dir, delete, ship

VOCAB = "group_name string, idx long, token string, freq long, code array<int>, path array<int>"
MATRIX = "matrix string, row_idx long, vec array<float>"
#: Order of the header fields and matrices in the binary file.
HEADER = ("d_word", "d_patient", "d_encounter", "d_out", "min_n", "max_n", "threshold", "window_size")
MATRICES = ("output", "ngram", "input", "W_proj", "patient", "encounter")
GROUPS = ("word", "patient", "encounter")


@dataclass
class Model:
    """meta: header fields, ngram_buckets and training settings; vocab and matrices as tables. N-gram rows that no word touches may be absent: they count as zero.

    An ensemble is one model whose tables have a column replicate_id; `replicates` names its values.
    """

    meta: dict
    vocab: DataFrame
    matrices: DataFrame
    replicates: tuple[int, ...] = ()

    @property
    def by(self) -> list[str]:
        return ["replicate_id"] if self.replicates else []

    def words(self, group: str = "word") -> DataFrame:
        return self.vocab.filter(F.col("group_name") == group).select(*self.by, "idx", "token", "freq", "code", "path")

    def matrix(self, name: str) -> DataFrame:
        return self.matrices.filter(F.col("matrix") == name).select(*self.by, "row_idx", "vec")


#: Matrices that queries join row by row, and so are worth a layout by row.
BY_ROW = ("ngram", "input")


def save(model: Model, path: str, buckets: int = 0) -> None:
    """With `buckets`, the n-gram and input matrices are written in so many files by the hash of a row's number, so that queries of the loaded model join them where they lie."""
    spark = model.vocab.sparkSession
    model.vocab.write.mode("overwrite").partitionBy("group_name").parquet(f"{path}/vocab")
    rest = model.matrices.filter(~F.col("matrix").isin(*BY_ROW)) if buckets else model.matrices
    rest.write.mode("overwrite").partitionBy("matrix").parquet(f"{path}/matrices")
    for name in BY_ROW if buckets else ():
        table = f"covarium_{uuid.uuid4().hex}"
        rows = model.matrix(name).repartition(buckets, "row_idx")
        rows.write.format("parquet").mode("overwrite").bucketBy(buckets, "row_idx").sortBy("row_idx").option("path", f"{path}/buckets/{name}").saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")  # its files stay: they aren't the catalogue's
    meta = {**model.meta, "buckets": buckets} if buckets else model.meta
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


class _ByRow(Model):
    def __init__(self, meta: dict, vocab: DataFrame, rest: DataFrame, by_row: dict[str, DataFrame]):
        whole = rest
        for name, rows in by_row.items():
            whole = whole.unionByName(rows.select(F.lit(name).alias("matrix"), "row_idx", "vec"))
        super().__init__(meta, vocab, whole)
        self.by_row = by_row

    def matrix(self, name: str) -> DataFrame:
        return self.by_row[name] if name in self.by_row else super().matrix(name)


def _bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """Files of `save` as a table that Spark knows to be bucketed; the catalogue's entry lasts as long as the session."""
    table = f"covarium_{uuid.uuid4().hex}"
    quoted = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {table} (row_idx BIGINT, vec ARRAY<FLOAT>) USING parquet CLUSTERED BY (row_idx) SORTED BY (row_idx) INTO {buckets} BUCKETS LOCATION '{quoted}'")
    atexit.register(_drop, spark, table)
    return spark.table(table)


def _drop(spark: SparkSession, table: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone at exit
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def load(spark: SparkSession, path: str) -> Model:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    v = spark.read.parquet(f"{path}/vocab").select("group_name", "idx", "token", "freq", "code", "path")
    m = spark.read.parquet(f"{path}/matrices").select("matrix", "row_idx", "vec")
    n = meta.pop("buckets", 0)
    return _ByRow(meta, v, m, {k: _bucketed(spark, f"{path}/buckets/{k}", n) for k in BY_ROW}) if n else Model(meta, v, m)


# ---------------------------------------------------------------- binary file

#: Bytes that are read, turned into a table or written at a time: neither the driver nor a row ever holds a file.
CHUNK = 32 << 20


class _Bytes:
    """Little-endian numbers from a file of any store that Spark reaches, read chunk by chunk. `place` is where in the file the next one is."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            raise FileNotFoundError(path)
        self.stream, self.jvm = fs.open(p), jvm
        self.held, self.at, self.place = b"", 0, 0

    def jump(self, place: int) -> None:
        self.stream.seek(place)
        self.held, self.at, self.place = b"", 0, place

    def take(self, n: int) -> bytes:
        if n > len(self.held) - self.at:
            parts, missing = [self.held[self.at :]], n - (len(self.held) - self.at)
            while missing > 0:
                got = bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(self.jvm.org.apache.commons.io.input.BoundedInputStream(self.stream, CHUNK)))
                if not got:
                    raise EOFError("the model file ends too early")
                parts.append(got)
                missing -= len(got)
            self.held, self.at = b"".join(parts), 0
        self.at += n
        self.place += n
        return self.held[self.at - n : self.at]

    def ints(self, n: int) -> tuple[int, ...]:
        return struct.unpack(f"<{n}i", self.take(4 * n))

    def close(self) -> None:
        self.stream.close()


def _put(spark: SparkSession, folder: str, table: pa.Table, schema: str) -> None:
    spark.createDataFrame(table, schema).coalesce(1).write.mode("append").parquet(folder)


def from_binary(spark: SparkSession, path: str) -> Model:
    """Reads a native model file of any size. The matrices are read by tasks, by ranges of rows (`ModelFile`), where executors can open the path; the driver reads the length-prefixed rest, CHUNK bytes at a time.

    In a store that only Spark's own readers reach, the driver reads the matrices too, in order, and writes each part to a table in the shared scratch folder.
    """
    f = _Bytes(spark, path)
    meta = dict(zip(HEADER, f.ints(8), strict=True))
    sizes = dict(zip((*GROUPS, "ngram", "output"), f.ints(5), strict=True))
    scratch = f"{checkpoint_dir(spark)}/covarium-{uuid.uuid4().hex}-model"
    atexit.register(delete, spark, scratch)
    tokens, lists, matrices = "group_name string, idx long, place long, token string", "place long, part string, list array<int>", MATRIX
    for g in GROUPS:
        rows, held = [], 0
        for i in range(sizes[g]):
            (n,) = struct.unpack("<I", f.take(4))
            token = f.take(n).decode()
            rows.append((g, f.ints(1)[0], i, token))
            held += n + 64
            if held > CHUNK or i == sizes[g] - 1:
                _put(spark, f"{scratch}/tokens", pa.table(dict(zip(("group_name", "idx", "place", "token"), map(list, zip(*rows, strict=True)), strict=True))), tokens)
                rows, held = [], 0
    d = meta["d_word"] + meta["d_patient"] + meta["d_encounter"]
    shapes = {"output": (sizes["output"], meta["d_out"]), "ngram": (sizes["ngram"], meta["d_word"]), "input": (sizes["word"], meta["d_word"]), "W_proj": (meta["d_out"], d), "patient": (sizes["patient"], meta["d_patient"]), "encounter": (sizes["encounter"], meta["d_encounter"])}
    layout, place = [], f.place
    for name in MATRICES:
        layout.append((name, place, *shapes[name]))
        place += 4 * shapes[name][0] * shapes[name][1]
    split = opens(path)
    if split:
        f.jump(place)
    else:
        for name, _, r, c in layout:
            step = max(1, CHUNK // max(1, 4 * c))
            for at in range(0, r, step):
                n = min(step, r - at)
                a = np.frombuffer(f.take(4 * n * c), "<f4").reshape(n, c)
                _put(spark, f"{scratch}/matrices", _matrix_rows(name, a, np.arange(at, at + n)), matrices)
    for part in ("code", "path"):
        rows, held = [], 0
        for i in range(sizes["word"]):
            (n,) = struct.unpack("<I", f.take(4))
            rows.append((i, part, f.ints(n)))
            held += 4 * n + 64
            if held > CHUNK or i == sizes["word"] - 1:
                _put(spark, f"{scratch}/lists", pa.table({"place": [r[0] for r in rows], "part": [r[1] for r in rows], "list": pa.array([r[2] for r in rows], pa.list_(pa.int32()))}), lists)
                rows, held = [], 0
    f.close()
    meta["ngram_buckets"] = sizes["ngram"]
    read = lambda part, schema: spark.read.schema(schema).parquet(f"{scratch}/{part}")
    vocab = read("tokens", tokens) if any(sizes[g] for g in GROUPS) else spark.createDataFrame([], tokens)
    coded = read("lists", lists) if sizes["word"] else spark.createDataFrame([], lists)
    pick = lambda p: coded.filter(F.col("part") == p).select(F.lit("word").alias("group_name"), "place", F.col("list").alias(p))
    vocab = vocab.join(pick("code"), ["group_name", "place"], "left").join(pick("path"), ["group_name", "place"], "left")
    return Model(meta, vocab.select("group_name", "idx", "token", F.lit(None).cast("long").alias("freq"), "code", "path"), matrix_rows(spark, path, layout) if split else read("matrices", matrices))


# ---------------------------------------------------------------- matrices of a file, by tasks


def local_path(path: str) -> str | None:
    """The path as the operating system opens it, for one without a scheme or of the file system."""
    scheme, colon, rest = path.partition(":")
    return path if not colon or "/" in scheme else re.sub("^/*", "/", rest) if scheme == "file" else None


def opened(path: str):
    """A binary file for reading at any place: of a shared file system, or of a store that Arrow reaches."""
    if (own := local_path(path)) is not None:
        return open(own, "rb")
    from pyarrow.fs import FileSystem

    store, inner = FileSystem.from_uri(path)
    return store.open_input_file(inner)


def opens(path: str) -> bool:
    try:
        opened(path).close()
    except (OSError, ValueError, ImportError, pa.ArrowException):
        return False
    return True


class ModelFile(DataSource):
    """The matrices of a native model file as rows of MATRIX. Option `layout`: JSON of (matrix, place in the file, rows, columns); `chunk`: bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "covarium_model"

    def schema(self) -> str:
        return MATRIX

    def reader(self, schema) -> DataSourceReader:
        return _ModelReader(self.options["path"], json.loads(self.options["layout"]), int(self.options.get("chunk", CHUNK)))


class _ModelReader(DataSourceReader):
    def __init__(self, path: str, layout: list, chunk: int):
        self.path, self.layout, self.chunk = path, layout, chunk

    def partitions(self) -> list[InputPartition]:
        out = []
        for name, place, rows, cols in self.layout:
            step = max(1, self.chunk // max(1, 4 * cols))
            out += [InputPartition((name, place + 4 * cols * at, at, min(step, rows - at), cols)) for at in range(0, rows, step)]
        return out or [InputPartition(("", 0, 0, 0, 1))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        name, place, first, rows, cols = partition.value
        with opened(self.path) as f:
            f.seek(place)
            for at in range(first, first + rows, 8192):
                n = min(8192, first + rows - at)
                got = f.read(4 * n * cols)
                if len(got) < 4 * n * cols:
                    raise EOFError("the model file ends too early")
                yield from _matrix_rows(name, np.frombuffer(got, "<f4").reshape(n, cols), np.arange(at, at + n)).to_batches()


def matrix_rows(spark: SparkSession, path: str, layout: list) -> DataFrame:
    ship(spark)
    spark.dataSource.register(ModelFile)
    return spark.read.format("covarium_model").option("layout", json.dumps(layout)).option("chunk", str(CHUNK)).load(path)


def write_matrices(matrices: DataFrame, path: str, layout: list) -> None:
    """Tasks write their rows at their places of an existing file that all of them can open. A task that is run again writes the same bytes."""
    where = {name: (place, cols) for name, place, _, cols in layout}
    ship(matrices.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        with open(path, "r+b") as f:
            for b in batches:
                for name, row, vec in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    place, cols = where[name]
                    f.seek(place + 4 * cols * row)
                    f.write(vec.values.to_numpy(zero_copy_only=False).astype("<f4").tobytes())
                    written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written])], names=["n"])

    matrices.select("matrix", "row_idx", "vec").repartitionByRange("matrix", "row_idx").sortWithinPartitions("matrix", "row_idx").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _matrix_rows(name: str, a: np.ndarray, rows: np.ndarray) -> pa.Table:
    n, d = a.shape
    vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(a, np.float32).reshape(-1)))
    return pa.table({"matrix": pa.array([name] * n), "row_idx": pa.array(rows, pa.int64()), "vec": vec})


def matrix_table(spark: SparkSession, name: str, a: np.ndarray, rows: np.ndarray | None = None) -> DataFrame:
    if not len(a):
        return spark.createDataFrame([], MATRIX)
    return spark.createDataFrame(_matrix_rows(name, a, np.arange(len(a)) if rows is None else rows), MATRIX)


def write_binary(model: Model, path: str) -> None:
    """Writes the native file, of any size. On a file system that driver and executors share, tasks write the matrices at their places, and the driver the length-prefixed rest; absent n-gram rows are zeros.

    In another store, rows come to the driver in order, a partition at a time, and go out CHUNK bytes at a time.
    """
    own = local_path(path)
    if own is not None:
        sizes, layout = _layout(model)
        with open(own, "wb") as f:
            for part in _head(model, sizes):
                f.write(part)
            place = f.tell()
            layout = [(name, place + at, r, c) for name, at, r, c in layout]
            end = layout[-1][1] + 4 * layout[-1][2] * layout[-1][3]
            f.truncate(end)
            f.seek(end)
            for part in _tail(model):
                f.write(part)
        write_matrices(model.matrices, own, layout)
        return
    spark = model.vocab.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    held, size = [], 0
    for part in binary_parts(model):
        held.append(part)
        size += len(part)
        if size > CHUNK:
            stream.write(bytearray(b"".join(held)))
            held, size = [], 0
    stream.write(bytearray(b"".join(held)))
    stream.close()


def to_binary(model: Model) -> bytes:
    """The native file's bytes, for models that fit one machine."""
    return b"".join(binary_parts(model))


def _layout(model: Model) -> tuple[dict[str, int], list[tuple]]:
    """Sizes of the groups, and (matrix, place after the first matrix's begin, rows, columns) in the file's order."""
    m = model.meta
    counts = {r.group_name: r["count"] for r in model.vocab.groupBy("group_name").count().collect()}
    sizes = {g: counts.get(g, 0) for g in GROUPS}
    d = m["d_word"] + m["d_patient"] + m["d_encounter"]
    n_out = max(1, sizes["word"] - 1)
    shapes = {"output": (n_out, m["d_out"]), "ngram": (m["ngram_buckets"], m["d_word"]), "input": (sizes["word"], m["d_word"]), "W_proj": (m["d_out"], d), "patient": (sizes["patient"], m["d_patient"]), "encounter": (sizes["encounter"], m["d_encounter"])}
    layout, at = [], 0
    for name in MATRICES:
        layout.append((name, at, *shapes[name]))
        at += 4 * shapes[name][0] * shapes[name][1]
    return sizes, layout


def _head(model: Model, sizes: dict[str, int]) -> Iterator[bytes]:
    m = model.meta
    yield struct.pack("<8i", *[int(m[h]) for h in HEADER]) + struct.pack("<5i", *[sizes[g] for g in GROUPS], m["ngram_buckets"], max(1, sizes["word"] - 1))
    for g in GROUPS:
        for r in model.words(g).select("idx", "token").orderBy("idx").toLocalIterator():
            t = r.token.encode()
            yield struct.pack("<I", len(t)) + t + struct.pack("<i", r.idx)


def _tail(model: Model) -> Iterator[bytes]:
    for field in ("code", "path"):
        for r in model.words("word").select("idx", field).orderBy("idx").toLocalIterator():
            v = r[field] or []
            yield struct.pack(f"<I{len(v)}i", len(v), *v)


def binary_parts(model: Model) -> Iterator[bytes]:
    sizes, layout = _layout(model)
    yield from _head(model, sizes)
    for name, _, n, c in layout:
        at, zero = 0, bytes(4 * c)
        for r in model.matrix(name).orderBy("row_idx").toLocalIterator():
            yield zero * (r.row_idx - at) + np.array(r.vec, "<f4").tobytes()
            at = r.row_idx + 1
        for _ in range(n - at):
            yield zero
    yield from _tail(model)


# ---------------------------------------------------------------- ensembles


def replicate_ids(names: list[str], prefix: str) -> list[int]:
    """0 for the original `<prefix>`, then 1, 2, ... for `<prefix>_boot_i`, up to the first gap. Without the original there is no ensemble."""
    base = [re.sub(r"(\.bin)?/?$", "", n.rsplit("/", 1)[-1] if n[-1:] != "/" else n[:-1].rsplit("/", 1)[-1]) for n in names]
    if prefix not in base:
        raise FileNotFoundError(f"no original model {prefix}")
    found = {int(m[1]) for b in base if (m := re.fullmatch(re.escape(prefix) + r"_boot_(\d+)", b))}
    ids = [0]
    while ids[-1] + 1 in found:
        ids.append(ids[-1] + 1)
    return ids


def list_names(spark: SparkSession, folder: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [str(s.getPath().getName()) for s in fs.listStatus(p)]


def load_ensemble(spark: SparkSession, folder: str, prefix: str) -> dict[int, Model]:
    ids = replicate_ids(list_names(spark, folder), prefix)
    return {i: load(spark, f"{folder}/{prefix}" + (f"_boot_{i}" if i else "")) for i in ids}


_SHAPE = (*HEADER[:6], "ngram_buckets", "buckets")


def _same_shape(metas: list[dict]) -> dict:
    if any(m.get(k) != metas[0].get(k) for m in metas for k in _SHAPE):
        raise ValueError("the models of an ensemble differ in dimensions or n-grams")
    return metas[0]


def stacked(models: dict[int, Model]) -> Model:
    """The models as one, with replicate_id."""
    one = lambda part: reduce(DataFrame.unionByName, [getattr(m, part).withColumn("replicate_id", F.lit(i)) for i, m in models.items()])
    return Model(_same_shape([m.meta for m in models.values()]), one("vocab"), one("matrices"), tuple(models))


class _Stored(Model):
    """An ensemble's folders, read together: one scan for a group or a matrix, whatever the number of replicates."""

    def __init__(self, spark: SparkSession, meta: dict, paths: dict[int, str]):
        super().__init__(meta, None, None, tuple(paths))
        self.spark, self.paths = spark, paths

    def _read(self, part: str, schema: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        found = []
        for path in self.paths.values():
            p = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
            if p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
                found.append(f"{path}/{part}")
        if not found:
            return self.spark.createDataFrame([], f"replicate_id int, {schema}")
        number = F.regexp_extract(F.col("_metadata.file_path"), r"_boot_([0-9]+)/(?:vocab|matrices|buckets)/", 1)
        rows = self.spark.read.schema(schema).parquet(*found)
        return rows.select(F.when(number == "", 0).otherwise(number.cast("int")).alias("replicate_id"), *rows.columns)

    def words(self, group: str = "word") -> DataFrame:
        return self._read(f"vocab/group_name={group}", "idx long, token string, freq long, code array<int>, path array<int>")

    def matrix(self, name: str) -> DataFrame:
        part = f"buckets/{name}" if self.meta.get("buckets") and name in BY_ROW else f"matrices/matrix={name}"
        return self._read(part, "row_idx long, vec array<float>")


def ensemble(spark: SparkSession, folder: str, prefix: str) -> Model:
    """The original and its replicates as one model."""
    paths = {i: f"{folder}/{prefix}" + (f"_boot_{i}" if i else "") for i in replicate_ids(list_names(spark, folder), prefix)}
    metas = [json.loads(r.value) for r in spark.read.text([f"{p}/meta" for p in paths.values()]).collect()]  # one line for each model
    return _Stored(spark, _same_shape(metas), paths)


def write_field_dump(model: Model, path: str) -> None:
    """Sorted patient and encounter fields, one a line."""
    for g in ("patient", "encounter"):
        model.words(g).select("token").orderBy("token").coalesce(1).write.mode("overwrite").text(f"{path}/{g}")
