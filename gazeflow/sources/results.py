"""Feature tables, caches, models and result files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_features(df: DataFrame, path: str, split_col: str = "split", error_col: str | None = None) -> str | None:
    """Write a feature table by split, so that a read of one split opens its folder alone.

    Rows with an error go to a table of their own beside it, whose path is returned.
    """
    good, bad = df, None
    if error_col is not None:
        bad = f"{path.rstrip('/')}_errors"
        df.where(F.col(error_col).isNotNull()).write.mode("overwrite").parquet(bad)
        good = df.where(F.col(error_col).isNull()).drop(error_col)
    good.write.mode("overwrite").partitionBy(split_col).parquet(path)
    return bad


def read_split(spark: SparkSession, path: str, split: str, split_col: str = "split") -> DataFrame:
    return spark.read.parquet(path).where(F.col(split_col) == split)


def config_hash(config: dict) -> str:
    """Sixteen hexadecimal digits that name a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def cached(spark: SparkSession, path: str, config: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives for a configuration: read where it was written before, else written first."""
    place = f"{path.rstrip('/')}/config={config_hash(config)}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def read_ordered_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV rows with their order: ``_file`` and ``_row``, which rises along each file."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row"))


def last_rows(df: DataFrame, key: str) -> DataFrame:
    """Of rows of one key the last one in the order of file and row."""
    values = [c for c in df.columns if c not in (key, "_file", "_row")]
    last = df.groupBy(key).agg(F.max_by(F.struct(*values), F.struct("_file", "_row")).alias("_last"))
    return last.select(key, "_last.*")


def write_result_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    """One result file with a header: numbers rounded, infinities as ``inf``, null as an empty field."""

    def shown(name: str, kind: str) -> Column:
        if kind not in ("double", "float"):
            return F.col(name)
        v = F.round(F.col(name).cast("double"), digits)
        text = F.when(F.col(name) == float("inf"), "inf").when(F.col(name) == float("-inf"), "-inf").when(F.isnan(name), "nan")
        return F.coalesce(text, v.cast("string")).alias(name)

    df.select(*[shown(n, k) for n, k in df.dtypes]).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def save_model(spark: SparkSession, model: PipelineModel, path: str, config: dict) -> None:
    """A fitted pipeline with the configuration that it was fitted for."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "config string").coalesce(1).write.mode("overwrite").parquet(f"{path}/config")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.parquet(f"{path}/config").first()[0])


def png_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, valid) of PNG files from their first 24 bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(path)
    head = files.select("path", F.hex(F.substring("content", 1, 24)).alias("h"))
    number = lambda at: F.conv(F.substring("h", at, 8), 16, 10).cast("int")
    valid = F.col("h").startswith("89504E470D0A1A0A0000000D49484452") & (F.length("h") == 48)
    return head.select("path", F.when(valid, number(33)).alias("width"), F.when(valid, number(41)).alias("height"), valid.alias("valid"))


def subject_pools(images: DataFrame) -> DataFrame:
    """(subject_id, eye_state, n, paths in order) of scanned images."""
    pools = images.groupBy("subject_id", "eye_state").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("path")).alias("paths"))
    return pools.select("subject_id", "eye_state", "n", "paths")
