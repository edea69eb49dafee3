"""Readers of the tables that the queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a frame stream: (session, frame, ts, micros, closed, ear); errors count as closed eyes, the value as eye aspect ratio."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("frame"), "ts", micros.alias("micros"), (F.col("event_type") == "error").alias("closed"), F.col("value").alias("ear"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 gray images: (img, label, g), g an array of 64 values from 0 to 255, row by row."""
    gray = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 256 + 128))).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), "label", gray.alias("g"))
