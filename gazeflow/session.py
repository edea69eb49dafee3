"""Session helpers: shipping this package to executors and finding the shared folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_PACKAGE = Path(__file__).resolve().parent


def ensure_package(spark: SparkSession) -> None:
    """Make this package importable on every executor, once per Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_gazeflow_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="gazeflow-"), "gazeflow_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, str(Path("gazeflow") / p.relative_to(_PACKAGE)))
    sc.addPyFile(target)
    sc._gazeflow_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local runs where it is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if getattr(sc, "_gazeflow_dir", None) is None:
        sc._gazeflow_dir = "file://" + tempfile.mkdtemp(prefix="spark-gazeflow-")
        sc.setCheckpointDir(sc._gazeflow_dir)
    return sc._gazeflow_dir


def stored(df: DataFrame, name: str = "step", codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts the lineage durably."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gazeflow/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop the shuffle files behind what is now written
    back = spark.read.schema(df.schema).parquet(path)
    back._gazeflow_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    path = getattr(df, "_gazeflow_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of a few numbers each that may be broadcast: a few megabytes.
BROADCAST_ROWS = 250_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (stored, narrow) with a broadcast hint if it has at most so many rows; else as it is, so that both sides are shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes of an Arrow batch: a little less than the slices that workers handle at once.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 7 << 20


def in_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` on batches of a slice, unless the session says how large they are.

    By default a batch holds 10000 rows up to 64 MB, which the executor keeps outside of its heap and the worker once more.
    """
    conf = df.sparkSession.conf
    if BATCH_CONF not in conf.getAll:
        conf.set(BATCH_CONF, BATCH_BYTES)
    return df.mapInArrow(run, schema)
