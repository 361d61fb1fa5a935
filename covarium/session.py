"""Session helper, package shipping and shared scratch tables."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def session(app: str = "covarium", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the engine expects; a cluster's own settings win when `master` is None."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    b = (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
        .config("spark.ui.enabled", "false")
    )
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors once per application, so that Arrow functions can import it."""
    app = spark.sparkContext.applicationId
    with _SHIPPING:
        if app in _SHIPPED:
            return
        root = Path(__file__).resolve().parent
        out = os.path.join(tempfile.mkdtemp(prefix="covarium-"), "covarium.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        spark.sparkContext.addPyFile(out)
        _SHIPPED.add(app)


def is_local(master: str) -> bool:
    """One process: local, local[8], local[*], local[8, 2]. local-cluster has executors of its own."""
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors that the cluster names. Where none is set, a local master gets a folder of its own; a cluster is an error, as its executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="covarium-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the cluster's own cleaner takes the rest
        pass


def materialize(df: DataFrame, name: str = "t", codec: str | None = None) -> DataFrame:
    """Write `df` as Parquet under the shared checkpoint folder and read it back: lineage is cut, and a lost executor loses nothing. `codec`: of the files, for tables of much text."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/covarium-{uuid.uuid4().hex}-{name}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    atexit.register(delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._covarium_path = path
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` over as many partitions as there are cores, if a scan gives fewer (a file of one row group); as it is otherwise, so that large inputs aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores // 2 else df


def release(*tables: DataFrame) -> None:
    """Delete the files of tables from `materialize` that nothing reads any more, not even lazily."""
    for df in tables:
        delete(df.sparkSession, df._covarium_path)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs now: it acts when the plans that made them are collected, on an idle driver perhaps only after half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
