"""Packed images (img, h, w, data) as numpy stacks: all images of one size in an Arrow batch are handled at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import in_arrow
from ..sources.tables import images

#: Tiles along a side of a mosaic.
MOSAIC = 8
#: Pixels of a stack, and rows of image files, that are handled at once: working memory does not grow with Arrow's batches.
PIXELS, ROWS = 1 << 18, 64


def parts(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches cut into at most so many rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def stacks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions of the rows, images as n x h x w bytes) for each size of a batch's images, at most ``PIXELS`` in a stack; a row whose bytes don't fit its size is an error."""
    h, w = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("h", "w"))
    data = batch.column(batch.schema.get_field_index("data"))
    for size in sorted(set(zip(h.tolist(), w.tolist(), strict=True))):
        alike = np.flatnonzero((h == size[0]) & (w == size[1]))
        step = max(1, PIXELS // max(1, size[0] * size[1]))
        for at in (alike[i : i + step] for i in range(0, len(alike), step)):
            raw = b"".join(data[int(i)].as_py() for i in at)
            if len(raw) != len(at) * size[0] * size[1]:
                raise ValueError(f"an image of {size[0]} x {size[1]} has another number of bytes")
            yield at, np.frombuffer(raw, np.uint8).reshape(len(at), *size)


def mapped(df: DataFrame, f: Callable[[np.ndarray], dict[str, list | np.ndarray]], schema: str, keys: tuple[str, ...] = ("img",)) -> DataFrame:
    """The keys of each image and the columns that ``f`` makes of a stack: a value an image, in the order of the stack."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = df.select(*keys, "h", "w", "data")
    own = to_arrow_schema(_parse_datatype_string(schema))
    whole = ", ".join(f"{n} {dict(kept.dtypes)[n]}" for n in keys) + ", " + schema

    def run(batches):
        for batch in batches:
            for at, stack in stacks(batch):
                made = f(stack)
                cols = [batch.column(i).take(pa.array(at)) for i in range(len(keys))]
                cols += [made[n] if isinstance(made[n], pa.Array) else pa.array(made[n], own.field(n).type) for n in own.names]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, *own.names])

    return in_arrow(kept, run, whole)


def exploded(df: DataFrame, f: Callable[[np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]], schema: str, keys: tuple[str, ...] = ("img",)) -> DataFrame:
    """As ``mapped`` for functions that make any number of rows an image: ``f`` gives the rows' positions in the stack and their columns."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = df.select(*keys, "h", "w", "data")
    own = to_arrow_schema(_parse_datatype_string(schema))
    whole = ", ".join(f"{n} {dict(kept.dtypes)[n]}" for n in keys) + ", " + schema

    def run(batches):
        for batch in batches:
            for at, stack in stacks(batch):
                of, made = f(stack)
                cols = [batch.column(i).take(pa.array(at[of])) for i in range(len(keys))]
                cols += [pa.array(made[n], own.field(n).type) for n in own.names]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, *own.names])

    return in_arrow(kept, run, whole)


def hexed(g: str) -> Column:
    """Two hex digits for each whole number of an array."""
    return F.array_join(F.transform(g, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), "")


def packed(df: DataFrame) -> DataFrame:
    """(img, label, h, w, data) of images (img, label, g) whose pixels are arrays of 64 whole numbers."""
    return df.select("img", "label", F.lit(8).alias("h"), F.lit(8).alias("w"), F.unhex(hexed("g")).alias("data"))


def small_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8 x 8 images of the embeddings, packed."""
    return packed(images(spark, sf_dir))


def mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, label, h, w, data): images of 64 x 64 made of up to 64 embeddings with following ids, as 8 x 8 tiles; a missing tile is 128. The label is the first tile's.

    Column expressions alone, so that a task needs no Python worker beside that of the operator on the images.
    """
    n, side = MOSAIC * MOSAIC, MOSAIC * 8
    rows = images(spark, sf_dir)
    tile = F.struct(F.pmod("img", F.lit(n)).cast("int").alias("tile"), F.when(F.size("g") == 64, hexed("g")).alias("px"))
    whole = rows.select(F.floor(F.col("img") / n).alias("img"), "label", tile.alias("t")).groupBy("img").agg(F.min_by("label", "t.tile").alias("label"), F.collect_list("t").alias("tiles"))
    blank = F.when(F.col("img").isNotNull(), "80" * 64)
    every = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.array_max(F.filter("tiles", lambda t: t["tile"] == i)), F.struct(i.alias("tile"), blank.alias("px")))["px"])
    # eight pixels of a tile at a time, in the order of the image's rows; a tile that is no image of 8 x 8 leaves too few bytes
    strip = lambda all_, i: F.substring(all_[F.floor(i / side).cast("int") * MOSAIC + i % MOSAIC], F.floor(i / MOSAIC).cast("int") % 8 * 16 + 1, 16)
    # an array of one array: its only element is computed once, not for each strip
    data = F.transform(F.array(every), lambda all_: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(side * MOSAIC - 1)), lambda i: strip(all_, i)), ""))[0]
    return whole.select("img", "label", F.lit(side).alias("h"), F.lit(side).alias("w"), F.unhex(data).alias("data"))


def pixel_rows(df: DataFrame, image: Callable[[np.ndarray], np.ndarray], kind: str = "int") -> DataFrame:
    """(img, y, x, v) of the images that ``image`` makes of stacks."""

    def f(stack: np.ndarray):
        out = image(stack)
        n, h, w = out.shape
        y, x = np.mgrid[:h, :w]
        return np.repeat(np.arange(n), h * w), {"y": np.tile(y.ravel(), n), "x": np.tile(x.ravel(), n), "v": out.reshape(-1)}

    return exploded(df, f, f"y int, x int, v {kind}")
