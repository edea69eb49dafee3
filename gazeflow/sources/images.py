"""Image files and manifests: scans with metadata from file names, PNG encoding, manifest sinks."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Zero-padded numbers stay strings, so schemas are never inferred.
MANIFEST = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("filename", "class", "subject_id", "image_id")]
    + [T.StructField(n, T.IntegerType()) for n in ("gender", "glasses", "eye_state", "reflections", "lighting")]
    + [T.StructField("sensor", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("bytes", T.LongType()), T.StructField("sha256", T.StringType()), T.StructField("source_relpath", T.StringType())]
)
FIELDS = ("subject_id", "image_id", "gender", "glasses", "eye_state", "reflections", "lighting", "sensor")


def parsed_name(path: Column) -> Column:
    """Metadata of a file name with eight parts joined by underscores; null for other names."""
    parts = F.split(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""), "_")
    numbers = F.forall(F.slice(parts, 3, 5), lambda v: v.rlike("^[0-9]+$"))
    values = [parts[i].alias(n) if n in ("subject_id", "image_id", "sensor") else parts[i].try_cast("int").alias(n) for i, n in enumerate(FIELDS)]
    return F.when((F.size(parts) == 8) & numbers, F.struct(*values))


def labelled(meta: DataFrame) -> DataFrame:
    """Adds is_open, has_glasses and lighting_label."""
    return meta.withColumns({"is_open": F.col("eye_state") == 1, "has_glasses": F.col("glasses") == 1, "lighting_label": F.when(F.col("lighting") == 1, "good").otherwise("bad")})


def scan_images(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(path, h, w, channels, data, meta columns) of image files. Unreadable files are dropped; malformed names too unless ``strict``, which raises."""
    rows = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*").withColumn("meta", parsed_name(F.col("origin")))
    if strict:
        rows = rows.withColumn("meta", F.coalesce("meta", F.raise_error(F.concat(F.lit("malformed file name: "), F.col("origin"))).cast(rows.schema["meta"].dataType)))
    return rows.where("meta is not null").select(F.col("origin").alias("path"), F.col("height").alias("h"), F.col("width").alias("w"), F.col("nChannels").alias("channels"), "data", "meta.*")


def gray(image: Column, channels: Column) -> Column:
    """Gray values of BGR bytes; single-channel images as they are."""
    at = lambda i: F.conv(F.hex(F.substring(image, i, 1)), 16, 10).cast("int")
    n = F.length(image)
    one = F.transform(F.sequence(F.lit(1), n), at)
    three = F.transform(F.sequence(F.lit(1), n, F.lit(3)), lambda i: F.floor(at(i) * 0.114 + at(i + 1) * 0.587 + at(i + 2) * 0.299 + 0.5).cast("int"))
    return F.when(channels == 1, one).otherwise(three)


def read_manifest(spark: SparkSession, path: str, base: str) -> DataFrame:
    """Manifest rows with the image's path, made of the class and the file name."""
    rows = spark.read.schema(MANIFEST).option("header", True).csv(path)
    return rows.withColumn("path", F.concat_ws("/", F.lit(base), "class", "filename"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def png(image: np.ndarray) -> bytes:
    """An 8-bit gray PNG."""
    h, w = image.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.zeros((h, w + 1), np.uint8)
    rows[:, 1:] = image
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 9)) + chunk(b"IEND", b"")
