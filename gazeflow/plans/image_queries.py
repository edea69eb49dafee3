"""Image queries over the 8 x 8 fixture: packed expressions in Spark, exploded pixels and joins in the SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grids
from ..functions.grids import Grid, Kernel
from ..operators import masks
from ..sources.tables import images

GRID = Grid(8, 8)

PX = """px AS (SELECT e.vec_id AS img, e.label, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x,
  CAST(greatest(0, least(255, floor(CAST(e.embedding[i] AS DOUBLE) * 256 + 128))) AS INT) AS g FROM embeddings e, range(1, 65) t(i))"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def pixels(df: DataFrame, image: Column, kind: str = "int") -> DataFrame:
    """One row a pixel: (img, y, x, v)."""
    rows = df.select("img", F.posexplode(image).alias("i", "v"))
    return rows.select("img", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), F.col("v").cast(kind).alias("v"))


def add(name: str, build: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(images(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = sql


def pointwise(name: str, f: Callable[[Column], Column], sql: str) -> None:
    add(name, lambda d: pixels(d, F.transform("g", lambda g: f(g))), f"WITH {PX} SELECT img, y, x, CAST({sql} AS INT) AS v FROM px")


def whole(name: str, image: Callable[[Column], Column], sql: str, over: str) -> None:
    """Needs statistics of the whole image: the SQL has ``over`` as aggregates by image."""
    add(name, lambda d: pixels(d, image(F.col("g"))), f"WITH {PX}, s AS (SELECT img, {over} FROM px GROUP BY img) SELECT px.img, y, x, CAST({sql} AS INT) AS v FROM px JOIN s ON s.img = px.img")


def values(kernel: Kernel) -> str:
    return "(VALUES " + ", ".join(f"({dy}, {dx}, {k})" for dy, dx, k in kernel) + ") n(dy, dx, k)"


def near_sql(source: str, kernel: Kernel, aggregate: str, border: str, column: str = "g", kind: str = "INT") -> str:
    """A stencil by joining pixels with their neighbours."""
    rule = {"mirror": "7 - abs(7 - abs({}))", "clamp": "greatest(0, least(7, {}))", "drop": "{}"}[border]
    aggregate = aggregate.replace("V", f"p.{column}").replace("K", "n.k")
    return f"SELECT c.img, c.y, c.x, CAST({aggregate} AS {kind}) AS v FROM {source} c CROSS JOIN {values(kernel)} JOIN {source} p ON p.img = c.img AND p.y = {rule.format('c.y + n.dy')} AND p.x = {rule.format('c.x + n.dx')} GROUP BY c.img, c.y, c.x"


def stencil(name: str, image: Callable[[Column], Column], kernel: Kernel, aggregate: str, border: str = "mirror") -> None:
    add(name, lambda d: pixels(d, image(F.col("g"))), f"WITH {PX} {near_sql('px', kernel, aggregate, border)}")


# Pointwise transforms
pointwise("img_negative", lambda g: 255 - g, "255 - g")
pointwise("img_add_constant", lambda g: grids.clipped(g + 40), "least(255, g + 40)")
pointwise("img_gamma_inverse", lambda g: F.floor(F.round(F.pow(g / 255.0, F.lit(1 / 2.0)) * 255, 9)), "floor(round(pow(g / 255.0::DOUBLE, 0.5::DOUBLE) * 255, 9))")
pointwise("img_power_law", lambda g: F.floor(F.round(F.pow(g / 255.0, F.lit(2.0)) * 255, 9)), "floor(round(pow(g / 255.0::DOUBLE, 2.0::DOUBLE) * 255, 9))")
for _levels in (4, 16, 64):
    pointwise(f"img_quantize_{_levels}", lambda g, s=256 // _levels: F.floor(g / F.lit(s)) * F.lit(s) + F.lit(s // 2), f"g // {256 // _levels} * {256 // _levels} + {256 // _levels // 2}")
pointwise("img_threshold_dark", lambda g: (g <= 127).cast("int"), "g <= 127")
pointwise("img_binary_strict", lambda g: (g < 100).cast("int"), "g < 100")

# Transforms by statistics of the image
whole("img_log", lambda g: F.transform(g, lambda v: F.floor(F.round(255 / F.log1p(F.greatest(F.array_max(g), F.lit(1)).cast("double")) * F.log1p(v.cast("double")), 9))), "floor(round(255 / ln(1 + greatest(top, 1)::DOUBLE) * ln(1 + g::DOUBLE), 9))", "max(g) AS top")
whole("img_stretch", lambda g: F.transform(g, lambda v: F.when(F.array_max(g) == F.array_min(g), v).otherwise(F.floor((v - F.array_min(g)) * 255 / F.greatest(F.array_max(g) - F.array_min(g), F.lit(1))))), "CASE WHEN top = low THEN g ELSE (g - low) * 255 // greatest(top - low, 1) END", "max(g) AS top, min(g) AS low")
add("img_equalize", lambda d: pixels(d, grids.equalized(F.col("g"))), f"""WITH {PX}, h AS (SELECT img, g, count(*) AS c FROM px GROUP BY img, g), cdf AS (SELECT img, g, sum(c) OVER (PARTITION BY img ORDER BY g) AS k FROM h),
  s AS (SELECT img, min(k) AS low, max(k) AS n FROM cdf GROUP BY img)
SELECT px.img, y, x, CAST(CASE WHEN n = low THEN px.g ELSE round_even((k - low)::DOUBLE / (n - low) * 255, 0) END AS INT) AS v FROM px JOIN cdf ON cdf.img = px.img AND cdf.g = px.g JOIN s ON s.img = px.img""")

# Statistics
add("img_stats", lambda d: pixels(d, F.col("g")).groupBy("img").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.min("v").alias("low"), F.max("v").alias("top"), F.round(F.avg((F.col("v") >= 250).cast("int")), 6).alias("saturated")),
    f"WITH {PX} SELECT img, round(avg(g), 6) AS mean, round(stddev_pop(g), 6) AS std, min(g) AS low, max(g) AS top, round(avg((g >= 250)::INT), 6) AS saturated FROM px GROUP BY img")
add("img_histogram_16", lambda d: pixels(d, F.col("g")).groupBy("img", F.floor(F.col("v") / 16).alias("bin")).agg(F.count("*").alias("n")), f"WITH {PX} SELECT img, CAST(g // 16 AS BIGINT) AS bin, count(*) AS n FROM px GROUP BY 1, 2")
add("img_average_of_all", lambda d: pixels(d, F.col("g")).groupBy("y", "x").agg(F.floor(F.avg("v")).cast("int").alias("v")), f"WITH {PX} SELECT y, x, CAST(floor(avg(g)) AS INT) AS v FROM px GROUP BY y, x")
add("img_darkest_pixel", lambda d: d.select("img", F.array_min("g").alias("v"), (F.array_position("g", F.array_min("g")) - 1).cast("int").alias("at")), f"WITH {PX} SELECT img, g AS v, CAST(y * 8 + x AS INT) AS at FROM px QUALIFY row_number() OVER (PARTITION BY img ORDER BY g, y, x) = 1")
add("img_mean_by_label", lambda d: d.groupBy("label").agg(F.round(F.avg(grids.image_mean(F.col("g"))), 6).alias("mean"), F.count("*").alias("n")), f"WITH {PX}, m AS (SELECT img, label, avg(g) AS m FROM px GROUP BY img, label) SELECT label, round(avg(m), 6) AS mean, count(*) AS n FROM m GROUP BY label")

# Smoothing and sharpening
stencil("img_mean_3", lambda g: GRID.mean(g, 3), grids.box(3), "floor((sum(V) * 2 + 9) / 18.0)")
stencil("img_mean_5", lambda g: GRID.mean(g, 5), grids.box(5), "floor((sum(V) * 2 + 25) / 50.0)")
stencil("img_gauss_3", GRID.gauss, grids.GAUSS, "floor((sum(V * K) + 8) / 16.0)")
stencil("img_median_3", lambda g: GRID.median(g, 3), grids.box(3), "quantile_disc(V, 0.5)", "clamp")
stencil("img_median_5", lambda g: GRID.median(g, 5), grids.box(5), "quantile_disc(V, 0.5)", "clamp")
stencil("img_laplacian_sharpen", GRID.sharpen, grids.SHARPEN, "greatest(0, least(255, sum(V * K)))")
_BLUR = f"blur AS ({near_sql('px', grids.GAUSS, 'floor((sum(V * K) + 8) / 16.0)', 'mirror')})"
for _name, _f, _sql in (("img_unsharp", GRID.unsharp, "2 * g - v"), ("img_high_boost", GRID.high_boost, "floor(g * 1.5::DOUBLE - v)")):
    add(_name, lambda d, f=_f: pixels(d, f(F.col("g"))), f"WITH {PX}, {_BLUR} SELECT px.img, px.y, px.x, CAST(greatest(0, least(255, {_sql})) AS INT) AS v FROM px JOIN blur b ON b.img = px.img AND b.y = px.y AND b.x = px.x")

# Edges
for _name, _kx, _ky in (("sobel", grids.SOBEL_X, grids.SOBEL_Y), ("prewitt", grids.PREWITT_X, grids.PREWITT_Y), ("roberts", grids.ROBERTS_X, grids.ROBERTS_Y)):
    _pair = f"a AS ({near_sql('px', _kx, 'sum(V * K)', 'mirror')}), b AS ({near_sql('px', _ky, 'sum(V * K)', 'mirror')})"
    add(f"img_{_name}", lambda d, kx=_kx, ky=_ky: pixels(d, F.transform(GRID.gradient(F.col("g"), kx, ky), lambda v: F.round(v, 6)), "double"), f"WITH {PX}, {_pair} SELECT a.img, a.y, a.x, round(sqrt((a.v * a.v + b.v * b.v)::DOUBLE), 6) AS v FROM a JOIN b USING (img, y, x)")
    add(f"img_{_name}_edges", lambda d, kx=_kx, ky=_ky: edges(d, kx, ky), f"""WITH {PX}, {_pair}, m AS (SELECT a.img, a.y, a.x, sqrt((a.v * a.v + b.v * b.v)::DOUBLE) AS v FROM a JOIN b USING (img, y, x)),
t AS (SELECT img, max(v) AS top FROM m GROUP BY img) SELECT m.img, CAST(count(*) FILTER (top > 0 AND floor(round(v / top * 255, 6)) > 25) AS BIGINT) AS n_edges FROM m JOIN t ON t.img = m.img GROUP BY m.img""")
stencil("img_laplacian", lambda g: GRID.weighted(g, grids.LAPLACE8), grids.LAPLACE8, "sum(V * K)")


def edges(d: DataFrame, kx: Kernel, ky: Kernel) -> DataFrame:
    """Pixels whose magnitude, scaled by the image's highest, is above 25."""
    scaled = lambda m: grids.let(F.array_max(m), lambda top: F.size(F.filter(m, lambda v: (top > 0) & (F.floor(F.round(v / top * 255, 6)) > 25))))
    return d.select("img", grids.let(GRID.gradient(F.col("g"), kx, ky), scaled).cast("long").alias("n_edges"))


#: Exact: sums of whole numbers over a power of two.
_EXACT = "(64 * sum(v * v) - sum(v) * sum(v)) / CAST(4096 AS DOUBLE) AS variance"
add("img_laplacian_variance", lambda d: pixels(d, GRID.weighted(F.col("g"), grids.LAPLACE4)).selectExpr("img", "bigint(v) AS v").groupBy("img").agg(F.expr(_EXACT)), f"WITH {PX}, l AS ({near_sql('px', grids.LAPLACE4, 'sum(V * K)', 'mirror')}) SELECT img, {_EXACT} FROM l GROUP BY img")

# Thresholds
_OTSU = """o AS (SELECT img, t FROM (SELECT a.img, a.g AS t, count(*) AS n0, sum(b.g) AS s0 FROM (SELECT DISTINCT img, g FROM px) a JOIN px b ON b.img = a.img AND b.g <= a.g GROUP BY a.img, a.g)
  JOIN (SELECT img, count(*) AS n, sum(g) AS s FROM px GROUP BY img) USING (img)
  QUALIFY row_number() OVER (PARTITION BY img ORDER BY round(CASE WHEN n0 < n THEN pow(s0::DOUBLE * n - s::DOUBLE * n0, 2) / (n0::DOUBLE * (n - n0)) ELSE -1 END, 6) DESC, t) = 1)"""
add("img_otsu", lambda d: d.select("img", grids.otsu(F.col("g")).alias("threshold")), f"WITH {PX}, {_OTSU} SELECT img, t AS threshold FROM o")
add("img_otsu_dark_share", lambda d: d.select("img", grids.let(grids.otsu(F.col("g")), lambda t: F.size(F.filter("g", lambda v: v <= t)) / 64).alias("share")), f"WITH {PX}, {_OTSU} SELECT px.img, avg((g <= t)::INT) AS share FROM px JOIN o ON o.img = px.img GROUP BY px.img")
add("img_adaptive_mean", lambda d: pixels(d, GRID.adaptive(F.col("g"))), f"WITH {PX}, m AS ({near_sql('px', grids.box(3), 'floor((sum(V) * 2 + 9) / 18.0)', 'mirror')}) SELECT px.img, px.y, px.x, CAST(g <= v - 3 AS INT) AS v FROM px JOIN m ON m.img = px.img AND m.y = px.y AND m.x = px.x")

# Morphology of dark masks
_MASK = "mask AS (SELECT img, y, x, CAST(g < 120 AS INT) AS g FROM px)"


def dark(d: DataFrame) -> DataFrame:
    return d.withColumn("m", F.transform("g", lambda v: (v < 120).cast("int")))


for _se, _kernel in (("square", grids.SQUARE), ("cross", grids.CROSS)):
    for _op, _f, _steps in (("erode", GRID.erode, ("min",)), ("dilate", GRID.dilate, ("max",)), ("open", GRID.opened, ("min", "max")), ("close", GRID.closed, ("max", "min"))):
        _sql = near_sql("mask", _kernel, f"{_steps[0]}(V)", "drop")
        _ctes = f"WITH {PX}, {_MASK}"
        if len(_steps) == 2:
            _ctes += f", s AS ({_sql})"
            _sql = near_sql("s", _kernel, f"{_steps[1]}(V)", "drop", "v")
        # given to explode itself: as a column, the stencil would make the mask anew at each of its places, and run again in the filter that Spark infers
        add(f"mask_{_op}_{_se}", lambda d, f=_f, k=_kernel: pixels(dark(d), f(F.col("m"), k)), f"{_ctes} {_sql}")
add("img_erode_gray", lambda d: pixels(d, GRID.erode(F.col("g"))), f"WITH {PX} {near_sql('px', grids.SQUARE, 'min(V)', 'drop')}")
add("mask_boundary", lambda d: dark(d).select("img", F.aggregate(F.zip_with("m", GRID.each(lambda y, x: F.array_min(F.array(*[F.coalesce(v, F.lit(0)) for v in GRID.near(F.col("m"), grids.CROSS, y, x, "drop")]))), lambda a, b: a - b), F.lit(0), lambda s, v: s + v).cast("long").alias("boundary")),
    f"WITH {PX}, {_MASK}, e AS (SELECT c.img, c.y, c.x, c.g AS own, min(coalesce(p.g, 0)) AS v FROM mask c CROSS JOIN {values(grids.CROSS)} LEFT JOIN mask p ON p.img = c.img AND p.y = c.y + n.dy AND p.x = c.x + n.dx GROUP BY ALL) SELECT img, CAST(sum(own - v) AS BIGINT) AS boundary FROM e GROUP BY img")
add("mask_thin_gap", lambda d: dark(d).select("img", *(F.aggregate(a, F.lit(0), lambda s, v: s + v).cast("long").alias(n) for n, a in (("area", F.col("m")), ("thin", F.zip_with("m", GRID.opened(F.col("m")), lambda a, b: a - b)), ("gap", F.zip_with(GRID.closed(F.col("m")), "m", lambda a, b: a - b))))),
    f"""WITH {PX}, {_MASK}, e AS ({near_sql("mask", grids.SQUARE, "min(V)", "drop")}), o AS ({near_sql("e", grids.SQUARE, "max(V)", "drop", "v")}),
d AS ({near_sql("mask", grids.SQUARE, "max(V)", "drop")}), c AS ({near_sql("d", grids.SQUARE, "min(V)", "drop", "v")})
SELECT m.img, CAST(sum(m.g) AS BIGINT) AS area, CAST(sum(m.g - o.v) AS BIGINT) AS thin, CAST(sum(c.v - m.g) AS BIGINT) AS gap FROM mask m JOIN o USING (img, y, x) JOIN c USING (img, y, x) GROUP BY m.img""")
add("mask_duality", lambda d: dark(d).select("img", F.aggregate(F.zip_with(F.transform(GRID.erode(F.col("m")), lambda v: 1 - v), GRID.dilate(F.transform("m", lambda v: 1 - v)), lambda a, b: F.abs(a - b)), F.lit(0), lambda s, v: s + v).cast("long").alias("differing")), f"""WITH {PX}, {_MASK}, inverse AS (SELECT img, y, x, 1 - g AS g FROM mask), e AS ({near_sql('mask', grids.SQUARE, 'min(V)', 'drop')}), i AS ({near_sql('inverse', grids.SQUARE, 'max(V)', 'drop')})
SELECT e.img, CAST(sum(abs(1 - e.v - i.v)) AS BIGINT) AS differing FROM e JOIN i USING (img, y, x) GROUP BY e.img""")

# Components
_REACH = """reach AS (SELECT img, y, x, y * 8 + x AS l FROM mask WHERE g = 1 UNION SELECT p.img, p.y, p.x, r.l FROM reach r JOIN mask p ON p.img = r.img AND p.g = 1 AND abs(p.y - r.y) <= 1 AND abs(p.x - r.x) <= 1{}),
c AS (SELECT img, y, x, min(l) AS l FROM reach GROUP BY img, y, x), a AS (SELECT img, l, count(*) AS n FROM c GROUP BY img, l)"""


def regions(d: DataFrame, eight: bool) -> DataFrame:
    """Components of the dark mask and the area of the largest."""
    labels = masks.with_labels(dark(d).withColumnRenamed("m", "mask"), eight=eight).select("img", F.explode("labels").alias("v")).where("v >= 0").groupBy("img", "v").agg(F.count("*").alias("n"))
    found = labels.groupBy("img").agg(F.count("*").alias("n_components"), F.max("n").alias("largest"))
    return d.select("img").join(found, "img", "left").select("img", F.coalesce("n_components", F.lit(0)).alias("n_components"), F.coalesce("largest", F.lit(0)).alias("largest"))


for _n, _eight in ((8, True), (4, False)):
    add(f"mask_components_{_n}", lambda d, e=_eight: regions(d, e), f"WITH RECURSIVE {PX}, {_MASK}, {_REACH.format('' if _eight else ' AND abs(p.y - r.y) + abs(p.x - r.x) <= 1')} SELECT e.vec_id AS img, CAST(count(a.l) AS BIGINT) AS n_components, CAST(coalesce(max(a.n), 0) AS BIGINT) AS largest FROM embeddings e LEFT JOIN a ON a.img = e.vec_id GROUP BY e.vec_id")

# Pairs of images
_NEXT = "JOIN px q ON q.img = p.img + 1 AND q.y = p.y AND q.x = p.x"


def pairs(d: DataFrame) -> DataFrame:
    """Each image with the next one."""
    return d.join(d.select((F.col("img") - 1).alias("img"), F.col("g").alias("h")), "img")


add("pair_blend", lambda d: pixels(pairs(d), F.zip_with("g", "h", lambda a, b: F.floor((a + b) / 2))), f"WITH {PX} SELECT p.img, p.y, p.x, CAST((p.g + q.g) // 2 AS INT) AS v FROM px p {_NEXT}")
add("pair_difference", lambda d: pixels(pairs(d), F.zip_with("g", "h", lambda a, b: F.abs(a - b))), f"WITH {PX} SELECT p.img, p.y, p.x, CAST(abs(p.g - q.g) AS INT) AS v FROM px p {_NEXT}")
add("pair_psnr", lambda d: pairs(d).withColumn("mse", grids.squared_error(F.col("g"), F.col("h"))).select("img", F.round("mse", 6).alias("mse"), F.round(grids.psnr(F.col("mse")), 6).alias("psnr")), f"WITH {PX}, m AS (SELECT p.img, avg((p.g - q.g) * (p.g - q.g)) AS mse FROM px p {_NEXT} GROUP BY p.img) SELECT img, round(mse, 6) AS mse, round(CASE WHEN mse = 0 THEN 'inf'::DOUBLE ELSE 10 * log10(65025 / mse) END, 6) AS psnr FROM m")


def overlap(d: DataFrame) -> DataFrame:
    p = pairs(d).select("img", F.transform("g", lambda v: v < 120).alias("a"), F.transform("h", lambda v: v < 120).alias("b"))
    count = lambda f: F.size(F.filter(F.zip_with("a", "b", f), lambda v: v))
    c = p.select("img", count(lambda a, b: a & b).alias("i"), count(lambda a, b: a | b).alias("u"))
    return c.select("img", F.round(F.when(F.col("u") == 0, 1.0).otherwise(F.col("i") / F.greatest("u", F.lit(1))), 6).alias("iou"), F.round(F.when(F.col("u") == 0, 1.0).otherwise(2 * F.col("i") / F.greatest(F.col("u") + F.col("i"), F.lit(1))), 6).alias("dice"))


add("pair_iou_dice", overlap, f"WITH {PX}, c AS (SELECT p.img, count(*) FILTER (p.g < 120 AND q.g < 120) AS i, count(*) FILTER (p.g < 120 OR q.g < 120) AS u FROM px p {_NEXT} GROUP BY p.img) SELECT img, round(CASE WHEN u = 0 THEN 1 ELSE i::DOUBLE / u END, 6) AS iou, round(CASE WHEN u = 0 THEN 1 ELSE 2::DOUBLE * i / (u + i) END, 6) AS dice FROM c")
add("img_noise_proxy", lambda d: pixels(d, F.zip_with("g", GRID.median(F.col("g")), lambda a, b: a - b)).groupBy("img").agg(F.round(F.stddev_pop("v"), 6).alias("noise")), f"WITH {PX}, m AS ({near_sql('px', grids.box(3), 'quantile_disc(V, 0.5)', 'clamp')}) SELECT px.img, round(stddev_pop(g - v), 6) AS noise FROM px JOIN m ON m.img = px.img AND m.y = px.y AND m.x = px.x GROUP BY px.img")
_SOBEL = f"a AS ({near_sql('px', grids.SOBEL_X, 'sum(V * K)', 'mirror')}), b AS ({near_sql('px', grids.SOBEL_Y, 'sum(V * K)', 'mirror')}), m AS (SELECT a.img, a.y, a.x, sqrt((a.v * a.v + b.v * b.v)::DOUBLE) AS v FROM a JOIN b USING (img, y, x))"
add("pair_edge_preservation", lambda d: edge_preservation(d), f"WITH {PX}, {_SOBEL} SELECT p.img, round(corr(p.v, q.v), 6) AS r FROM m p JOIN m q ON q.img = p.img + 1 AND q.y = p.y AND q.x = p.x GROUP BY p.img")


def edge_preservation(d: DataFrame) -> DataFrame:
    """Pearson correlation of the gradient magnitudes of two images."""
    rows = pairs(d.select("img", GRID.gradient(F.col("g")).alias("g"))).select("img", F.explode(F.arrays_zip("g", "h")).alias("z"))
    return rows.groupBy("img").agg(F.round(F.corr("z.g", "z.h"), 6).alias("r"))


# Texture
stencil_lbp = [(-1, -1, 1), (-1, 0, 2), (-1, 1, 4), (0, 1, 8), (1, 1, 16), (1, 0, 32), (1, -1, 64), (0, -1, 128)]
add("img_lbp_histogram", lambda d: pixels(d, GRID.lbp(F.col("g"))).groupBy("img", F.col("v").alias("code")).agg(F.count("*").alias("n")), f"WITH {PX}, l AS (SELECT c.img, c.y, c.x, CAST(sum(CASE WHEN p.g >= c.g THEN n.k ELSE 0 END) AS INT) AS code FROM px c CROSS JOIN {values(stencil_lbp)} JOIN px p ON p.img = c.img AND p.y = greatest(0, least(7, c.y + n.dy)) AND p.x = greatest(0, least(7, c.x + n.dx)) GROUP BY c.img, c.y, c.x) SELECT img, code, count(*) AS n FROM l GROUP BY img, code")
