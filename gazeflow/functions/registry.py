"""Operators by name: each takes a packed image and named parameters, so that sweeps are relations and not loops."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grids


@dataclass(frozen=True)
class Operator:
    build: Callable[..., Column]
    parameters: dict[str, float]


REGISTRY: dict[str, Operator] = {}


def register(name: str, build: Callable[..., Column], **parameters: float) -> None:
    """``build(grid, image, **parameters)`` gives the new image; the parameters' values are defaults."""
    REGISTRY[name] = Operator(build, parameters)


def apply(name: str, image: Column, grid: grids.Grid, **parameters: float) -> Column:
    if name not in REGISTRY:
        raise KeyError(f"no operator {name!r}; there are {', '.join(sorted(REGISTRY))}")
    if unknown := set(parameters) - set(REGISTRY[name].parameters):
        raise TypeError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    return REGISTRY[name].build(grid, image, **(REGISTRY[name].parameters | parameters))


def sweep(df: DataFrame, image: str, grid: grids.Grid, steps: list[tuple[str, str, dict[str, float]]]) -> DataFrame:
    """``df`` with a row for each step (label, operator, parameters): columns technique and out; one pass, no join."""
    made = F.array(*[F.struct(F.lit(label).alias("technique"), apply(name, F.col(image), grid, **p).alias("out")) for label, name, p in steps])
    return df.withColumn("_made", F.explode(made)).select(*df.columns, "_made.technique", "_made.out")


def create_sql_functions(spark: SparkSession) -> list[str]:
    """Pointwise operators as temporary SQL functions on one gray value, and ``pixels`` as a table function of a packed image."""
    made = []
    for name, body in (("gaze_negative", "255 - g"), ("gaze_add_constant", "least(255, greatest(0, g + 40))"), ("gaze_threshold", "if(g <= 127, 1, 0)")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(g INT) RETURNS INT RETURN {body}")
        made.append(name)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION gaze_pixels(image ARRAY<INT>, width INT) RETURNS TABLE (y INT, x INT, g INT) RETURN SELECT CAST(pos DIV width AS INT), CAST(pos % width AS INT), col FROM (SELECT posexplode(image))")
    return [*made, "gaze_pixels"]


def gaussian(grid: grids.Grid, image: Column, size: int = 5) -> Column:
    kernel = grids.binomial(size)
    total = sum(k for _, _, k in kernel)
    return F.transform(grid.weighted(image, kernel), lambda s: F.floor((s + total // 2) / total).cast("int"))


register("negative", lambda _, g: F.transform(g, lambda v: 255 - v))
register("add_constant", lambda _, g, value: F.transform(g, lambda v: grids.clipped(v + F.lit(int(value)))), value=40)
register("gamma", lambda _, g, gamma: F.transform(g, lambda v: F.floor(F.round(F.pow(v / 255.0, F.lit(1.0 / gamma)) * 255, 9)).cast("int")), gamma=1.5)
register("quantize", lambda _, g, levels: F.transform(g, lambda v: (F.floor(v / F.lit(256 // int(levels))) * F.lit(256 // int(levels)) + F.lit(256 // int(levels) // 2)).cast("int")), levels=16)
register("mean", lambda grid, g, size: grid.mean(g, int(size)), size=3)
register("gaussian", lambda grid, g, size: gaussian(grid, g, int(size)), size=5)
register("median", lambda grid, g, size: grid.median(g, int(size)), size=3)
register("sharpen", lambda grid, g: grid.sharpen(g))
register("equalize", lambda _, g: grids.equalized(g))
