"""Sweeps, noise, resampling, segmentation and mask measures over the 8 x 8 fixture."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grids, registry, resample
from ..operators import masks
from . import image_queries, transform_queries
from .image_queries import _MASK, _REACH, GRID, PX, dark, near_sql, pairs, pixels, values
from .relational_queries import ORACLE_SQL as RELATIONAL_SQL
from .relational_queries import QUERIES as RELATIONAL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, build, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(image_queries.images(spark, sf_dir))
    ORACLE_SQL[name] = sql


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, v: s + v)


# Representation
add("img_properties", lambda d: d.select("img", F.lit(8).alias("height"), (F.size("g") / 8).cast("int").alias("width"), F.lit(1).alias("channels"), F.size("g").alias("total_pixels"), F.lit("uint8").alias("dtype"), F.size("g").alias("bytes")),
    "SELECT vec_id AS img, 8 AS height, CAST(len(embedding) // 8 AS INT) AS width, 1 AS channels, CAST(len(embedding) AS INT) AS total_pixels, 'uint8' AS dtype, CAST(len(embedding) AS INT) AS bytes FROM embeddings")


def pixel_at(image: Column, y: int, x: int, height: int = 8, width: int = 8) -> Column:
    """A pixel's value; outside of the image it is an error."""
    inside = 0 <= y < height and 0 <= x < width
    return F.get(image, F.lit(y * width + x)) if inside else F.raise_error(F.lit(f"pixel ({y}, {x}) is outside of {height} x {width}")).cast("int")


add("img_pixel_at", lambda d: d.select("img", pixel_at(F.col("g"), 3, 4).alias("v")), f"WITH {PX} SELECT img, g AS v FROM px WHERE y = 3 AND x = 4")


def hsv(d: DataFrame) -> DataFrame:
    """Hue (0 to 179), saturation and value of images whose planes are three following images."""
    later = lambda k, n: d.select((F.col("img") - k).alias("img"), F.col("g").alias(n))
    rows = d.select("img", F.col("g").alias("r")).join(later(1, "gr"), "img").join(later(2, "b"), "img").select("img", F.posexplode(F.arrays_zip("r", "gr", "b")).alias("i", "p")).select("img", "i", "p.*")
    high, low = F.greatest("r", "gr", "b"), F.least("r", "gr", "b")
    span = F.greatest(high - low, F.lit(1))
    hue = F.when(high == low, 0).when(high == F.col("r"), (F.col("gr") - F.col("b")) / span * 30).when(high == F.col("gr"), (F.col("b") - F.col("r")) / span * 30 + 60).otherwise((F.col("r") - F.col("gr")) / span * 30 + 120)
    hue = F.floor(F.round(F.when(hue < 0, hue + 180).otherwise(hue), 6) + 0.5)
    sat = F.when(high == 0, 0).otherwise(F.floor(F.round((high - low) * 255 / F.greatest(high, F.lit(1)), 6) + 0.5))
    return rows.select("img", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), (hue % 180).cast("int").alias("h"), sat.cast("int").alias("s"), high.cast("int").alias("v"))


_HSV = f"""{PX}, c AS (SELECT r.img, r.y, r.x, r.g AS r, q.g AS gr, b.g AS b, greatest(r.g, q.g, b.g) AS hi, least(r.g, q.g, b.g) AS lo FROM px r JOIN px q ON q.img = r.img + 1 AND q.y = r.y AND q.x = r.x JOIN px b ON b.img = r.img + 2 AND b.y = r.y AND b.x = r.x),
h AS (SELECT *, CASE WHEN hi = lo THEN 0 WHEN hi = r THEN (gr - b)::DOUBLE / (hi - lo) * 30 WHEN hi = gr THEN (b - r)::DOUBLE / (hi - lo) * 30 + 60 ELSE (r - gr)::DOUBLE / (hi - lo) * 30 + 120 END AS hue FROM c),
hsv AS (SELECT img, y, x, CAST(floor(round(CASE WHEN hue < 0 THEN hue + 180 ELSE hue END, 6) + 0.5::DOUBLE) AS INT) % 180 AS h, CAST(CASE WHEN hi = 0 THEN 0 ELSE floor(round((hi - lo) * 255::DOUBLE / hi, 6) + 0.5::DOUBLE) END AS INT) AS s, CAST(hi AS INT) AS v FROM h)"""
add("img_hsv_planes", hsv, f"WITH {_HSV} SELECT * FROM hsv")
add("img_hsv_ranges", lambda d: hsv(d).groupBy("img").agg(*[f(c).alias(f"{n}_{c}") for c in "hsv" for n, f in (("low", F.min), ("top", F.max))]), f"WITH {_HSV} SELECT img, min(h) AS low_h, max(h) AS top_h, min(s) AS low_s, max(s) AS top_s, min(v) AS low_v, max(v) AS top_v FROM hsv GROUP BY img")


def axis_sql(rows: resample.Axis) -> str:
    return "(VALUES " + ", ".join(f"({t}, {s}, {w!r}::DOUBLE)" for t, s, w in rows) + ")"


for _name, _kind, _size in (("downsample_4", "area", 4), ("downsample_6", "area", 6), ("upscale_nearest_16", "nearest", 16), ("upscale_linear_16", "linear", 16), ("upscale_cubic_12", "cubic", 12)):
    _axis = resample.axis(8, _size, _kind)
    add(f"img_{_name}", lambda d, a=_axis, n=_size: d.select("img", F.posexplode(resample.resized(F.col("g"), 8, a, a)).alias("i", "v")).select("img", F.floor(F.col("i") / n).cast("int").alias("y"), (F.col("i") % n).cast("int").alias("x"), "v"),
        f"WITH {PX} SELECT img, CAST(r.t AS INT) AS y, CAST(c.t AS INT) AS x, CAST(greatest(0, least(255, floor(round(sum(g * (r.w * c.w)), 6) + 0.5::DOUBLE))) AS INT) AS v FROM px JOIN {axis_sql(_axis)} r(t, s, w) ON r.s = y JOIN {axis_sql(_axis)} c(t, s, w) ON c.s = x GROUP BY img, r.t, c.t")
_ROWS, _COLS = resample.axis(4, 4, "area"), resample.axis(8, 8, "area")
add("img_letterbox_8", lambda d: d.select("img", F.posexplode(resample.letterboxed(F.slice("g", 1, 32), 4, 8, 8, 7)).alias("i", "v")).select("img", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), "v"),
    f"WITH {PX} SELECT p.img, p.y, p.x, CAST(coalesce(q.g, 7) AS INT) AS v FROM px p LEFT JOIN px q ON q.img = p.img AND q.x = p.x AND q.y = p.y - 2 AND q.y BETWEEN 0 AND 3")
add("img_padded", lambda d: d.select("img", F.posexplode(GRID.each(lambda y, x: GRID.at(F.col("g"), F.least(y, F.lit(5)), F.least(x, F.lit(6))))).alias("i", "v")).select("img", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), "v"),
    f"WITH {PX} SELECT p.img, p.y, p.x, q.g AS v FROM px p JOIN px q ON q.img = p.img AND q.y = least(p.y, 5) AND q.x = least(p.x, 6)")

# Enhancement
def percentile_stretch(d: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Linear map of the range between two percentiles (linear interpolation) to 0 to 255; unchanged where they are equal."""

    def at(s: Column, share: float) -> Column:
        place = 63 * share
        k, part = math.floor(place), place - math.floor(place)
        return F.get(s, F.lit(k)) + (F.get(s, F.lit(min(63, k + 1))) - F.get(s, F.lit(k))) * F.lit(part)

    ends = d.withColumn("s", F.sort_array("g")).withColumn("a", F.round(at(F.col("s"), low), 6)).withColumn("b", F.round(at(F.col("s"), high), 6))
    return pixels(ends, F.transform("g", lambda v: F.when(F.col("a") >= F.col("b"), v).otherwise(grids.clipped(F.floor(F.round((v - F.col("a")) * 255 / F.greatest(F.col("b") - F.col("a"), F.lit(1e-6)), 6))))))


add("img_stretch_percentile", percentile_stretch, f"WITH {PX}, s AS (SELECT img, round(quantile_cont(g::DOUBLE, 0.02), 6) AS a, round(quantile_cont(g::DOUBLE, 0.98), 6) AS b FROM px GROUP BY img) SELECT px.img, y, x, CAST(CASE WHEN a >= b THEN g ELSE greatest(0, least(255, floor(round((g - a) * 255 / (b - a), 6)))) END AS INT) AS v FROM px JOIN s ON s.img = px.img")


def library_equalized(image: Column) -> Column:
    """Equalisation by a scale in single precision, as imaging libraries do it."""
    n = F.size(image)

    def spread(low: Column) -> Column:
        scale = (F.lit(255.0).cast("float") / F.greatest(n - low, F.lit(1)).cast("float")).cast("float")
        return F.transform(image, lambda g: F.when(n == low, g).otherwise(F.bround(((F.size(F.filter(image, lambda v: v <= g)) - low).cast("float") * scale).cast("float").cast("double")).cast("int")))

    return grids.let(grids.let(F.array_min(image), lambda m: F.size(F.filter(image, lambda v: v == m))), spread)


_EQ = f"""{PX}, h AS (SELECT img, g, count(*) AS c FROM px GROUP BY img, g), cdf AS (SELECT img, g, sum(c) OVER (PARTITION BY img ORDER BY g) AS k FROM h), s AS (SELECT img, min(k) AS low, max(k) AS n FROM cdf GROUP BY img),
e AS (SELECT px.img, y, x, CAST(CASE WHEN n = low THEN px.g ELSE round_even((k - low)::DOUBLE / (n - low) * 255, 0) END AS INT) AS own, CAST(CASE WHEN n = low THEN px.g ELSE round_even(((k - low)::FLOAT * (255::FLOAT / (n - low)::FLOAT))::DOUBLE, 0) END AS INT) AS lib FROM px JOIN cdf ON cdf.img = px.img AND cdf.g = px.g JOIN s ON s.img = px.img)"""
add("img_equalize_library", lambda d: pixels(d, library_equalized(F.col("g"))), f"WITH {_EQ} SELECT img, y, x, lib AS v FROM e")
add("img_equalize_difference", lambda d: d.select("img", F.array_max(F.zip_with(grids.equalized(F.col("g")), library_equalized(F.col("g")), lambda a, b: F.abs(a - b))).alias("most")), f"WITH {_EQ} SELECT img, max(abs(own - lib)) AS most FROM e GROUP BY img")

_TECHNIQUES = [("negative", "negative", {}), ("add_40", "add_constant", {"value": 40}), ("gamma_0.5", "gamma", {"gamma": 0.5}), ("gamma_2", "gamma", {"gamma": 2.0}), ("quantize_4", "quantize", {"levels": 4}), ("quantize_16", "quantize", {"levels": 16}), ("mean_3", "mean", {"size": 3})]
_MEAN3 = near_sql("px", grids.box(3), "floor((sum(V) * 2 + 9) / 18.0)", "mirror")
_TECH_SQL = f"""t AS (SELECT img, 'negative' AS technique, 255 - g AS v FROM px UNION ALL SELECT img, 'add_40', least(255, g + 40) FROM px UNION ALL SELECT img, 'gamma_0.5', CAST(floor(round(pow(g / 255.0::DOUBLE, 2.0::DOUBLE) * 255, 9)) AS INT) FROM px
  UNION ALL SELECT img, 'gamma_2', CAST(floor(round(pow(g / 255.0::DOUBLE, 0.5::DOUBLE) * 255, 9)) AS INT) FROM px UNION ALL SELECT img, 'quantize_4', CAST(g // 64 * 64 + 32 AS INT) FROM px UNION ALL SELECT img, 'quantize_16', CAST(g // 16 * 16 + 8 AS INT) FROM px UNION ALL SELECT img, 'mean_3', v FROM ({_MEAN3}) m),
b AS (SELECT img, stddev_pop(g) AS std FROM px GROUP BY img), gains AS (SELECT t.img, technique, round(avg(v), 4) AS brightness, round(stddev_pop(v), 4) AS contrast, round(CASE WHEN any_value(b.std) > 0 THEN stddev_pop(v) / any_value(b.std) ELSE 0 END, 4) AS contrast_gain FROM t JOIN b ON b.img = t.img GROUP BY t.img, technique)"""


def variance(a: Column) -> Column:
    """Population variance of whole numbers, from exact sums."""
    n = F.size(a)
    return (F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v * v) * n - F.pow(F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v), F.lit(2))) / (n * n)


def deviation(a: Column) -> Column:
    return F.sqrt(variance(a))


def technique_gains(d: DataFrame) -> DataFrame:
    swept = registry.sweep(d.withColumn("std", deviation(F.col("g"))), "g", GRID, _TECHNIQUES)
    return swept.select("img", "technique", F.round(total(F.col("out")) / 64, 4).alias("brightness"), F.round(deviation(F.col("out")), 4).alias("contrast"), F.round(F.when(F.col("std") > 0, deviation(F.col("out")) / F.greatest("std", F.lit(1e-9))).otherwise(0.0), 4).alias("contrast_gain"))


add("technique_gains", technique_gains, f"WITH {PX}, {_TECH_SQL} SELECT * FROM gains")
add("technique_winners", lambda d: technique_gains(d).groupBy("img").agg(F.max_by("technique", F.struct("contrast_gain", "technique")).alias("winner"), F.max("contrast_gain").alias("gain")), f"WITH {PX}, {_TECH_SQL} SELECT img, technique AS winner, contrast_gain AS gain FROM gains QUALIFY row_number() OVER (PARTITION BY img ORDER BY contrast_gain DESC, technique DESC) = 1")
_LEVELS = (2, 4, 8, 16, 32, 64, 128)


def quantize_sweep(d: DataFrame) -> DataFrame:
    rows = registry.sweep(d, "g", GRID, [(str(k), "quantize", {"levels": k}) for k in _LEVELS])
    m = rows.select(F.col("technique").cast("int").alias("levels"), grids.squared_error(F.col("g"), F.col("out")).alias("mse"), F.size(F.array_distinct("out")).alias("u"))
    return m.groupBy("levels").agg(F.round(F.avg("mse"), 4).alias("mse"), F.round(F.avg("u"), 4).alias("unique_values"))


add("quantize_sweep", quantize_sweep, f"WITH {PX}, q AS (SELECT l.levels, img, g, g // (256 // l.levels) * (256 // l.levels) + (256 // l.levels) // 2 AS v FROM px CROSS JOIN (VALUES {', '.join(f'({k})' for k in _LEVELS)}) l(levels)), m AS (SELECT levels, img, avg((g - v) * (g - v)) AS mse, count(DISTINCT v) AS u FROM q GROUP BY 1, 2) SELECT CAST(levels AS INT) AS levels, round(avg(mse), 4) AS mse, round(avg(u), 4) AS unique_values FROM m GROUP BY levels")
_GAMMAS = (0.6, 0.8, 1.0, 1.2, 1.5, 2.0)
add("gamma_sweep", lambda d: registry.sweep(d, "g", GRID, [(str(k), "gamma", {"gamma": k}) for k in _GAMMAS]).select(F.col("technique").cast("double").alias("gamma"), (F.size(F.filter("out", lambda v: v >= 200)) / 64).alias("s"), (total(F.col("out")) / 64).alias("m")).groupBy("gamma").agg(F.round(F.avg("s"), 6).alias("saturated"), F.round(F.avg("m"), 4).alias("mean")),
    f"WITH {PX}, v AS (SELECT gamma, floor(round(pow(g / 255.0::DOUBLE, 1.0::DOUBLE / gamma) * 255, 9)) AS v FROM px CROSS JOIN (VALUES {', '.join(f'({k}::DOUBLE)' for k in _GAMMAS)}) k(gamma)) SELECT gamma, round(avg((v >= 200)::INT), 6) AS saturated, round(avg(v), 4) AS mean FROM v GROUP BY gamma")


# Noise from hashes of image and place, so that it is the same however the rows are dealt
def hashed(img: Column, place: Column, salt: str) -> Column:
    return F.substring(F.md5(F.concat_ws("-", img.cast("string"), place.cast("string"), F.lit(salt))), 1, 12)


def uniform(img: Column, place: Column, salt: str) -> Column:
    return F.conv(F.substring(hashed(img, place, salt), 1, 8), 16, 10).cast("double") / 4294967296.0


def gaussian_noise(img: Column, image: Column, sigma: float, salt: str = "a") -> Column:
    """Noise of a normal distribution, truncated to whole numbers and clipped."""

    def one(v: Column, i: Column) -> Column:
        z = F.sqrt(F.log(1 - uniform(img, i, salt + "u")) * -2) * F.cos(uniform(img, i, salt + "v") * 2 * math.pi)
        return grids.clipped(F.floor(F.round(v + z * sigma, 6)))

    return F.transform(image, one)


def salt_and_pepper(img: Column, image: Column, amount: float, size: int = 64) -> Column:
    """Exactly round(amount * size) pixels become black or white in equal parts: those with the least hashes."""
    n = round(amount * size)
    keys = F.transform(image, lambda _, i: F.concat(hashed(img, i, "s"), F.lpad(i.cast("string"), 4, "0")))

    def changed(k: Column) -> Column:
        ends = F.struct(F.get(F.sort_array(k), F.lit(n // 2 - 1)).alias("white"), F.get(F.sort_array(k), F.lit(n - 1)).alias("black"))
        return grids.let(ends, lambda e: F.zip_with(image, k, lambda v, h: F.when(h <= e["white"], 255).when(h <= e["black"], 0).otherwise(v)))

    return grids.let(keys, changed)


def _uniform_sql(salt: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('-', img, y * 8 + x, '{salt}')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def _noisy_sql(sigma: float, salt: str = "a") -> str:
    return f"CAST(greatest(0, least(255, floor(round(g + sqrt(ln(1 - {_uniform_sql(salt + 'u')}) * -2) * cos({_uniform_sql(salt + 'v')} * 2 * pi()) * {sigma}::DOUBLE, 6)))) AS INT)"


_SP = "CASE WHEN row_number() OVER (PARTITION BY img ORDER BY substr(md5(concat_ws('-', img, y * 8 + x, 's')), 1, 12), y * 8 + x) <= 3 THEN 255 WHEN row_number() OVER (PARTITION BY img ORDER BY substr(md5(concat_ws('-', img, y * 8 + x, 's')), 1, 12), y * 8 + x) <= 6 THEN 0 ELSE g END"
add("img_gaussian_noise", lambda d: pixels(d, gaussian_noise(F.col("img"), F.col("g"), 20)), f"WITH {PX} SELECT img, y, x, {_noisy_sql(20)} AS v FROM px")
add("img_salt_pepper", lambda d: pixels(d, salt_and_pepper(F.col("img"), F.col("g"), 0.1)), f"WITH {PX} SELECT img, y, x, CAST({_SP} AS INT) AS v FROM px")


def averaged_copies(d: DataFrame, n: int = 5) -> DataFrame:
    """Error of one noisy copy and of the mean of n of them."""
    copies = [gaussian_noise(F.col("img"), F.col("g"), 20, str(k)) for k in range(n)]
    both = d.withColumn("c", F.array(*copies)).withColumn("mean", GRID.each(lambda y, x: F.floor(sum((F.get(F.get("c", F.lit(k)), y * 8 + x) for k in range(n)), F.lit(0)) / n).cast("int")))
    return both.select("img", F.round(grids.squared_error(F.col("g"), F.get("c", F.lit(0))), 6).alias("mse_one"), F.round(grids.squared_error(F.col("g"), F.col("mean")), 6).alias("mse_mean"))


add("averaged_noisy_copies", averaged_copies, f"WITH {PX}, c AS (SELECT img, y, x, g, {', '.join(f'{_noisy_sql(20, str(k))} AS c{k}' for k in range(5))} FROM px), m AS (SELECT img, g, c0, (c0 + c1 + c2 + c3 + c4) // 5 AS v FROM c) SELECT img, round(avg((g - c0) * (g - c0)), 6) AS mse_one, round(avg((g - v) * (g - v)), 6) AS mse_mean FROM m GROUP BY img")

_FILTERS = [(f, k) for f in ("mean", "gaussian", "median") for k in (3, 5)]


def factorial(d: DataFrame) -> DataFrame:
    """Mean PSNR of every filter on every noise, and the filters' ranks by noise."""
    noises = F.array(F.struct(F.lit("gaussian").alias("noise"), gaussian_noise(F.col("img"), F.col("g"), 20).alias("h")), F.struct(F.lit("salt_pepper").alias("noise"), salt_and_pepper(F.col("img"), F.col("g"), 0.1).alias("h")))
    rows = registry.sweep(d.withColumn("n", F.explode(noises)).select("img", "g", "n.*"), "h", GRID, [(f"{f} {k}", f, {"size": k}) for f, k in _FILTERS])
    scored = rows.select("noise", "technique", grids.squared_error(F.col("g"), F.col("out")).alias("mse")).where("mse > 0").withColumn("psnr", grids.psnr(F.col("mse")))
    return scored.groupBy("noise", "technique").agg(F.round(F.avg("psnr"), 4).alias("psnr"), F.count("*").alias("n"))


def _filter_sql(f: str, k: int) -> str:
    if f == "mean":
        return near_sql("n", grids.box(k), f"floor((sum(V) * 2 + {k * k}) / {2 * k * k}.0)", "mirror")
    if f == "median":
        return near_sql("n", grids.box(k), "quantile_disc(V, 0.5)", "clamp")
    weights = grids.binomial(k)
    n = sum(w for _, _, w in weights)
    return near_sql("n", weights, f"floor((sum(V * K) + {n // 2}) / {n}.0)", "mirror")


_FACTORIAL = f"""n AS (SELECT img * 2 AS img, y, x, {_noisy_sql(20)} AS g FROM px UNION ALL SELECT img * 2 + 1, y, x, CAST({_SP} AS INT) FROM px),
f AS ({' UNION ALL '.join(f"SELECT '{f} {k}' AS technique, * FROM ({_filter_sql(f, k)}) q{i}" for i, (f, k) in enumerate(_FILTERS))}),
m AS (SELECT f.img, technique, avg((p.g - f.v) * (p.g - f.v)) AS mse FROM f JOIN px p ON p.img = f.img // 2 AND p.y = f.y AND p.x = f.x GROUP BY f.img, technique)"""
add("noise_filter_factorial", factorial, f"WITH {PX}, {_FACTORIAL} SELECT CASE WHEN img % 2 = 0 THEN 'gaussian' ELSE 'salt_pepper' END AS noise, technique, round(avg(10 * log10(65025 / mse)), 4) AS psnr, count(*) AS n FROM m WHERE mse > 0 GROUP BY 1, 2")
add("noise_filter_best", lambda d: factorial(d).groupBy("noise").agg(F.max_by("technique", "psnr").alias("best")), f"WITH {PX}, {_FACTORIAL}, r AS (SELECT img % 2 AS k, technique, round(avg(10 * log10(65025 / mse)), 4) AS psnr FROM m WHERE mse > 0 GROUP BY 1, 2) SELECT CASE WHEN k = 0 THEN 'gaussian' ELSE 'salt_pepper' END AS noise, arg_max(technique, psnr) AS best FROM r GROUP BY k")

# Filters
_G5 = grids.binomial(5)
_BLUR5 = near_sql("px", _G5, "floor((sum(V * K) + 128) / 256.0)", "mirror")
add("img_gauss_5", lambda d: pixels(d, registry.gaussian(GRID, F.col("g"), 5)), f"WITH {PX} {_BLUR5}")
for _name, _f, _sql in (("unsharp_5", lambda g, b: grids.clipped(g * 2 - b), "2 * g - v"), ("high_boost_5", lambda g, b: grids.clipped(F.floor(g * 1.5 - b)), "floor(g * 1.5::DOUBLE - v)")):
    add(f"img_{_name}", lambda d, f=_f: pixels(d, F.zip_with("g", registry.gaussian(GRID, F.col("g"), 5), f)), f"WITH {PX}, b AS ({_BLUR5}) SELECT px.img, px.y, px.x, CAST(greatest(0, least(255, {_sql})) AS INT) AS v FROM px JOIN b ON b.img = px.img AND b.y = px.y AND b.x = px.x")
add("img_gradient_sharpen", lambda d: pixels(d, F.zip_with("g", GRID.gradient(F.col("g")), lambda g, m: grids.clipped(F.floor(F.round(g + m * 0.5, 6))))),
    f"WITH {PX}, {image_queries._SOBEL} SELECT px.img, px.y, px.x, CAST(greatest(0, least(255, floor(round(g + m.v * 0.5::DOUBLE, 6)))) AS INT) AS v FROM px JOIN m ON m.img = px.img AND m.y = px.y AND m.x = px.x")
add("img_adaptive_gauss", lambda d: pixels(d, F.zip_with("g", registry.gaussian(GRID, F.col("g"), 5), lambda g, m: (g <= m - 3).cast("int"))), f"WITH {PX}, b AS ({_BLUR5}) SELECT px.img, px.y, px.x, CAST(g <= v - 3 AS INT) AS v FROM px JOIN b ON b.img = px.img AND b.y = px.y AND b.x = px.x")
add("img_auto_seed", lambda d: d.withColumn("b", registry.gaussian(GRID, F.col("g"), 5)).select("img", (F.array_position("b", F.array_min("b")) - 1).cast("int").alias("at"), F.array_min("b").alias("v")), f"WITH {PX}, b AS ({_BLUR5}) SELECT img, CAST(y * 8 + x AS INT) AS at, v FROM b QUALIFY row_number() OVER (PARTITION BY img ORDER BY v, y, x) = 1")


def noise_std(a: Column) -> Column:
    return deviation(F.zip_with(a, GRID.median(a), lambda g, m: g - m))


add("noise_amplification", lambda d: d.withColumn("s", GRID.sharpen(F.col("g"))).select("img", F.round(F.when(noise_std(F.col("g")) > 0, noise_std(F.col("s")) / F.greatest(noise_std(F.col("g")), F.lit(1e-9))).otherwise(0.0), 4).alias("ratio")),
    f"""WITH {PX}, s AS ({near_sql('px', grids.SHARPEN, 'greatest(0, least(255, sum(V * K)))', 'mirror')}), a AS ({near_sql('px', grids.box(3), 'quantile_disc(V, 0.5)', 'clamp')}), b AS ({near_sql('s', grids.box(3), 'quantile_disc(V, 0.5)', 'clamp', 'v')}),
n AS (SELECT px.img, stddev_pop(px.g - a.v) AS before, stddev_pop(s.v - b.v) AS after FROM px JOIN a USING (img, y, x) JOIN s USING (img, y, x) JOIN b USING (img, y, x) GROUP BY px.img) SELECT img, round(CASE WHEN before > 0 THEN after / before ELSE 0 END, 4) AS ratio FROM n""")
add("img_region_keep", lambda d: pixels(d, F.transform("g", lambda v: F.when(v < 120, v).otherwise(255))), f"WITH {PX} SELECT img, y, x, CAST(CASE WHEN g < 120 THEN g ELSE 255 END AS INT) AS v FROM px")
add("img_scan_line", lambda d: d.select("img", F.posexplode(F.slice("g", 33, 8)).alias("x", "v"), "g").select("img", "x", "v", F.when(F.col("x") > 0, F.col("v") - F.get("g", 31 + F.col("x"))).alias("step")), f"WITH {PX} SELECT img, x, g AS v, CAST(g - lag(g) OVER (PARTITION BY img ORDER BY x) AS INT) AS step FROM px WHERE y = 4")
add("img_frame_difference", lambda d: pairs(d).select("img", F.round(total(F.zip_with("g", "h", lambda a, b: F.abs(a - b))) / 64, 6).alias("mean"), F.size(F.filter(F.zip_with("g", "h", lambda a, b: F.abs(a - b)), lambda v: v > 25)).alias("changed")),
    f"WITH {PX} SELECT p.img, round(avg(abs(p.g - q.g)), 6) AS mean, CAST(count(*) FILTER (abs(p.g - q.g) > 25) AS INT) AS changed FROM px p {image_queries._NEXT} GROUP BY p.img")
add("pair_mask_algebra", lambda d: pairs(d).select("img", *[F.size(F.filter(F.zip_with("g", "h", f), lambda v: v)).alias(n) for n, f in (("n_and", lambda a, b: (a < 120) & (b < 120)), ("n_or", lambda a, b: (a < 120) | (b < 120)), ("n_xor", lambda a, b: (a < 120) != (b < 120)), ("n_only", lambda a, b: (a < 120) & (b >= 120)), ("n_not", lambda a, _: a >= 120))]),
    f"WITH {PX} SELECT p.img, CAST(count(*) FILTER (p.g < 120 AND q.g < 120) AS INT) AS n_and, CAST(count(*) FILTER (p.g < 120 OR q.g < 120) AS INT) AS n_or, CAST(count(*) FILTER ((p.g < 120) <> (q.g < 120)) AS INT) AS n_xor, CAST(count(*) FILTER (p.g < 120 AND q.g >= 120) AS INT) AS n_only, CAST(count(*) FILTER (p.g >= 120) AS INT) AS n_not FROM px p {image_queries._NEXT} GROUP BY p.img")

# Segmentation
_SEG = f"{PX}, {image_queries._OTSU}, mask AS (SELECT px.img, y, x, CAST(10 * g < 7 * t AS INT) AS g FROM px JOIN o ON o.img = px.img), {_REACH.format('')}"


def largest(labels: DataFrame) -> DataFrame:
    """(img, first, area) of each image's largest component; the one that begins first of equal ones."""
    rows = labels.select("img", F.explode("labels").alias("l")).where("l >= 0").groupBy("img", "l").agg(F.count("*").alias("n"))
    return rows.groupBy("img").agg(F.max(F.struct("n", (-F.col("l")).alias("l"))).alias("b")).select("img", (-F.col("b.l")).alias("first"), F.col("b.n").alias("area"))


def segmented(d: DataFrame, least: int = 3) -> DataFrame:
    """Otsu's threshold, a stricter one at 0.7 of it, and the largest dark region of at least so many pixels."""
    both = grids.let(grids.otsu(F.col("g")), lambda t: F.struct(t.alias("threshold"), F.transform("g", lambda v: (v * 10 < t * 7).cast("int")).alias("mask")))
    t = d.select("img", "label", F.explode(F.array(both)).alias("o")).select("img", "label", "o.*")
    found = largest(masks.with_labels(t)).where(F.col("area") >= least)
    return t.select("img", "label", "threshold").join(found, "img", "left").select("img", "label", "threshold", F.coalesce("first", F.lit(-1)).alias("first"), F.coalesce("area", F.lit(0)).alias("area"), F.col("area").isNull().cast("int").alias("degenerate"))


_SEGMENTED = "best AS (SELECT img, l, n FROM a QUALIFY row_number() OVER (PARTITION BY img ORDER BY n DESC, l) = 1), seg AS (SELECT e.vec_id AS img, e.label, o.t AS threshold, CAST(coalesce(b.l, -1) AS INT) AS first, CAST(coalesce(b.n, 0) AS BIGINT) AS area, CAST(b.n IS NULL AS INT) AS degenerate FROM embeddings e JOIN o ON o.img = e.vec_id LEFT JOIN best b ON b.img = e.vec_id AND b.n >= 3)"
add("segment_eye", lambda d: segmented(d).drop("label"), f"WITH RECURSIVE {_SEG}, {_SEGMENTED} SELECT img, threshold, first, area, degenerate FROM seg")
add("degenerate_rate", lambda d: segmented(d).groupBy("label").agg(F.round(F.avg("degenerate"), 6).alias("rate"), F.count("*").alias("n")), f"WITH RECURSIVE {_SEG}, {_SEGMENTED} SELECT label, round(avg(degenerate), 6) AS rate, count(*) AS n FROM seg GROUP BY label")


def segment_grid(d: DataFrame) -> DataFrame:
    """Share of images without a region for each scale of the threshold and each least area."""
    scaled = grids.let(grids.otsu(F.col("g")), lambda t: F.transform(F.array(*map(F.lit, (5, 7, 9))), lambda s: F.struct(s.alias("scale"), F.transform("g", lambda v: (v * 10 < t * s).cast("int")).alias("mask"))))
    keyed = d.select("img", F.explode(scaled).alias("s")).select((F.col("img") * 16 + F.col("s.scale")).alias("img"), "s.mask")
    rows = keyed.select("img").join(largest(masks.with_labels(keyed)), "img", "left").withColumn("least", F.explode(F.array(*map(F.lit, (1, 3, 6)))))
    return rows.groupBy((F.col("img") % 16).cast("int").alias("scale"), "least").agg(F.round(F.avg((F.coalesce("area", F.lit(0)) < F.col("least")).cast("int")), 6).alias("degenerate"))


add("segment_grid", segment_grid, f"""WITH RECURSIVE {PX}, {image_queries._OTSU}, mask AS (SELECT px.img * 16 + s AS img, y, x, CAST(10 * g < s * t AS INT) AS g FROM px JOIN o ON o.img = px.img CROSS JOIN (VALUES (5), (7), (9)) k(s)), {_REACH.format('')},
b AS (SELECT i.img, coalesce(max(a.n), 0) AS n FROM (SELECT DISTINCT img FROM mask) i LEFT JOIN a ON a.img = i.img GROUP BY i.img) SELECT CAST(img % 16 AS INT) AS scale, k.l AS least, round(avg((n < k.l)::INT), 6) AS degenerate FROM b CROSS JOIN (VALUES (1), (3), (6)) k(l) GROUP BY 1, 2""")


def mask_labels(d: DataFrame, eight: bool = True) -> DataFrame:
    return masks.with_labels(dark(d).withColumnRenamed("m", "mask"), eight=eight)


def shapes(d: DataFrame) -> DataFrame:
    """Features of each mask's largest component."""
    one = mask_labels(d)
    rows = one.join(largest(one), "img").select("img", "area", "first", F.posexplode("labels").alias("i", "l")).where("l = first").select("img", "area", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"))
    m = rows.groupBy("img", "area").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"), (F.var_pop("y") + 1 / 12).alias("a"), (F.var_pop("x") + 1 / 12).alias("c"), F.covar_pop("y", "x").alias("b"), (F.max("y") - F.min("y") + 1).alias("h"), (F.max("x") - F.min("x") + 1).alias("w"))
    half, root = (F.col("a") + F.col("c")) / 2, F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, F.lit(2)) + F.col("b") * F.col("b"))
    return m.select("img", "area", F.round(F.col("area") / 64, 6).alias("area_ratio"), F.round(F.col("cy") / 8, 6).alias("row"), F.round(F.col("cx") / 8, 6).alias("col"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.round(1 - (half - root) / (half + root), 9))), 5).alias("eccentricity"), F.round(F.col("area") / (F.col("h") * F.col("w")), 6).alias("extent"), F.round(F.col("w") / F.col("h"), 6).alias("aspect"), F.round(F.col("h") / 8, 6).alias("vertical_extent"))


_BIG = f"{PX}, {_MASK}, {_REACH.format('')}, best AS (SELECT img, l, n FROM a QUALIFY row_number() OVER (PARTITION BY img ORDER BY n DESC, l) = 1), r AS (SELECT c.img, b.n AS area, c.y, c.x FROM c JOIN best b ON b.img = c.img AND b.l = c.l)"
add("mask_shape_features", shapes, f"""WITH RECURSIVE {_BIG}, m AS (SELECT img, area, avg(y) AS cy, avg(x) AS cx, var_pop(y) + 1 / 12.0::DOUBLE AS a, var_pop(x) + 1 / 12.0::DOUBLE AS c, covar_pop(y, x) AS b, max(y) - min(y) + 1 AS h, max(x) - min(x) + 1 AS w FROM r GROUP BY img, area),
q AS (SELECT *, (a + c) / 2 AS half, sqrt(pow((a - c) / 2, 2) + b * b) AS root FROM m) SELECT img, area, round(area / 64, 6) AS area_ratio, round(cy / 8, 6) AS row, round(cx / 8, 6) AS col, round(sqrt(greatest(0, round(1 - (half - root) / (half + root), 9))), 5) AS eccentricity, round(area / (h * w), 6) AS extent, round(w / h, 6) AS aspect, round(h / 8, 6) AS vertical_extent FROM q""")
add("mask_isolated", lambda d: mask_labels(d).select("img", F.explode("labels").alias("l")).where("l >= 0").groupBy("img", "l").agg(F.count("*").alias("n")).groupBy("img").agg(F.count("*").alias("n_components"), F.count_if(F.col("n") == 1).alias("isolated"), F.round(F.sum("n") / 64, 6).alias("foreground")),
    f"WITH RECURSIVE {PX}, {_MASK}, {_REACH.format('')} SELECT img, count(*) AS n_components, count(*) FILTER (n = 1) AS isolated, round(sum(n) / 64, 6) AS foreground FROM a GROUP BY img")
_DEPTH = f"depth AS (SELECT p.img, p.y, p.x, min(greatest(abs(p.y - q.y), abs(p.x - q.x))) AS k FROM mask p JOIN mask q ON q.img = p.img AND q.g = 0 WHERE p.g = 1 GROUP BY p.img, p.y, p.x)"
add("mask_vanish", lambda d: mask_labels(d).select("img", F.explode(F.arrays_zip("labels", "depths")).alias("z")).where("z.labels >= 0").groupBy("img", F.col("z.labels").alias("component")).agg(F.when(F.min("z.depths") > 0, F.max("z.depths")).alias("vanishes")),
    f"WITH RECURSIVE {PX}, {_MASK}, {_REACH.format('')}, {_DEPTH} SELECT c.img, CAST(c.l AS INT) AS component, CAST(max(k) AS INT) AS vanishes FROM c LEFT JOIN depth USING (img, y, x) GROUP BY c.img, c.l")
_L1 = "SELECT p.img, p.y, p.x, min(abs(p.y - q.y) + abs(p.x - q.x)) AS k FROM mask p LEFT JOIN mask q ON q.img = p.img AND q.g = {} WHERE p.g = {} GROUP BY p.img, p.y, p.x"
add("mask_erosion_curve", lambda d: masks.curves(dark(d).withColumnRenamed("m", "mask"), 14), f"WITH {PX}, {_MASK}, depth AS ({_L1.format(0, 1)}), s AS (SELECT CAST(i AS INT) AS k FROM range(0, 15) t(i)) SELECT e.vec_id AS img, s.k, count(d.img) AS n FROM embeddings e CROSS JOIN s LEFT JOIN depth d ON d.img = e.vec_id AND (d.k IS NULL OR d.k > s.k) GROUP BY 1, 2")
add("mask_dilation_curve", lambda d: masks.curves(dark(d).withColumnRenamed("m", "mask"), 14, dilate=True), f"WITH {PX}, {_MASK}, depth AS ({_L1.format(1, 0)}), s AS (SELECT CAST(i AS INT) AS k FROM range(0, 15) t(i)) SELECT e.vec_id AS img, s.k, 64 - count(d.img) AS n FROM embeddings e CROSS JOIN s LEFT JOIN depth d ON d.img = e.vec_id AND (d.k IS NULL OR d.k > s.k) GROUP BY 1, 2")


def measured(d: DataFrame) -> DataFrame:
    """Area, area fraction and change against the mask, of the mask, its erosion and its opening."""
    m = dark(d).withColumn("a", total(F.col("m")))
    rows = m.select("img", "a", F.explode(F.array(*[F.struct(F.lit(n).alias("op"), total(f).alias("n")) for n, f in (("mask", F.col("m")), ("erode", GRID.erode(F.col("m"))), ("open", GRID.opened(F.col("m"))), ("ellipse", GRID.erode(F.col("m"), grids.element("ellipse", 5))))])).alias("r"))
    return rows.select("img", "r.op", F.col("r.n").alias("area"), F.round(F.col("r.n") / 64, 6).alias("fraction"), F.round(F.when(F.col("a") > 0, (F.col("r.n") - F.col("a")) * 100 / F.greatest("a", F.lit(1))), 4).alias("pct_change"))


add("mask_measures", measured, f"""WITH {PX}, {_MASK}, e AS ({near_sql('mask', grids.SQUARE, 'min(V)', 'drop')}), w AS ({near_sql('e', grids.SQUARE, 'max(V)', 'drop', 'v')}), l AS ({near_sql('mask', grids.element('ellipse', 5), 'min(V)', 'drop')}),
u AS (SELECT img, 'mask' AS op, sum(g) AS n FROM mask GROUP BY img UNION ALL SELECT img, 'erode', sum(v) FROM e GROUP BY img UNION ALL SELECT img, 'open', sum(v) FROM w GROUP BY img UNION ALL SELECT img, 'ellipse', sum(v) FROM l GROUP BY img), b AS (SELECT img, sum(g) AS a FROM mask GROUP BY img)
SELECT u.img, op, CAST(n AS INT) AS area, round(n / 64, 6) AS fraction, round(CASE WHEN a > 0 THEN (n - a) * 100 / a END, 4) AS pct_change FROM u JOIN b ON b.img = u.img""")


# Region growing within a tolerance of the seed's value
def grown(d: DataFrame) -> DataFrame:
    """For each tolerance the region of the darkest pixel, against the dark mask: pixels, missing, leaking, IoU, growth."""
    seeds = d.withColumn("seed", (F.array_position("g", F.array_min("g")) - 1).cast("int")).withColumn("tolerance", F.explode(F.array(*map(F.lit, (10, 25, 45, 60)))))
    keyed = seeds.select((F.col("img") * 64 + F.col("tolerance")).alias("img"), "seed", "g", F.transform("g", lambda v: (v - F.array_min("g") <= F.col("tolerance")).cast("int")).alias("mask"))
    labels = masks.with_labels(keyed).select("img", "labels")
    r = keyed.join(labels, "img").withColumn("in", F.transform("labels", lambda l: l == F.get("labels", F.col("seed"))))
    count = lambda f: F.size(F.filter(F.zip_with("in", "g", f), lambda v: v))
    return r.select(F.floor(F.col("img") / 64).alias("img"), (F.col("img") % 64).cast("int").alias("tolerance"), count(lambda a, _: a).alias("pixels"), count(lambda a, g: ~a & (g < 120)).alias("missing"), count(lambda a, g: a & (g >= 120)).alias("leakage"), F.round(count(lambda a, g: a & (g < 120)) / count(lambda a, g: a | (g < 120)), 6).alias("iou"))


add("region_threshold_sweep", grown, f"""WITH RECURSIVE {PX}, low AS (SELECT img, min(g) AS m FROM px GROUP BY img), seed AS (SELECT img, y, x FROM px QUALIFY row_number() OVER (PARTITION BY img ORDER BY g, y, x) = 1),
t(tolerance) AS (VALUES (10), (25), (45), (60)), reach AS (SELECT img, tolerance, y, x FROM seed CROSS JOIN t UNION SELECT p.img, r.tolerance, p.y, p.x FROM reach r JOIN px p ON p.img = r.img AND abs(p.y - r.y) <= 1 AND abs(p.x - r.x) <= 1 JOIN low ON low.img = p.img AND p.g - low.m <= r.tolerance)
SELECT px.img, CAST(t.tolerance AS INT) AS tolerance, CAST(count(r.img) AS INT) AS pixels, CAST(count(*) FILTER (r.img IS NULL AND g < 120) AS INT) AS missing, CAST(count(*) FILTER (r.img IS NOT NULL AND g >= 120) AS INT) AS leakage, round(count(*) FILTER (r.img IS NOT NULL AND g < 120)::DOUBLE / count(*) FILTER (r.img IS NOT NULL OR g < 120), 6) AS iou
FROM px CROSS JOIN t LEFT JOIN reach r ON r.img = px.img AND r.tolerance = t.tolerance AND r.y = px.y AND r.x = px.x GROUP BY px.img, t.tolerance""")
add("mask_iou_otsu", lambda d: d.withColumn("t", grids.otsu(F.col("g"))).select("img", F.size(F.filter("g", lambda v: (v <= F.col("t")) & (v < 120))).alias("i"), F.size(F.filter("g", lambda v: (v <= F.col("t")) | (v < 120))).alias("u")).select("img", F.round(F.when(F.col("u") == 0, 1.0).otherwise(F.col("i") / F.greatest("u", F.lit(1))), 6).alias("iou")),
    f"WITH {PX}, {image_queries._OTSU} SELECT px.img, round(CASE WHEN count(*) FILTER (g <= t OR g < 120) = 0 THEN 1 ELSE count(*) FILTER (g <= t AND g < 120)::DOUBLE / count(*) FILTER (g <= t OR g < 120) END, 6) AS iou FROM px JOIN o ON o.img = px.img GROUP BY px.img")
add("threshold_comparison", lambda d: d.select("label", F.explode(F.array(*[F.struct(F.lit(n).alias("method"), (F.size(F.filter("g", f)) / 64).alias("share")) for n, f in (("fixed", lambda v: v <= 127),)], F.struct(F.lit("otsu").alias("method"), grids.let(grids.otsu(F.col("g")), lambda t: F.size(F.filter("g", lambda v: v <= t)) / 64).alias("share")), F.struct(F.lit("adaptive").alias("method"), (total(GRID.adaptive(F.col("g"))) / 64).alias("share")))).alias("r")).groupBy("label", "r.method").agg(F.round(F.avg("r.share"), 6).alias("share")),
    f"WITH {PX}, {image_queries._OTSU}, m AS ({_MEAN3}) SELECT label, k.method, round(avg(CASE k.method WHEN 'fixed' THEN (px.g <= 127)::INT WHEN 'otsu' THEN (px.g <= t)::INT ELSE (px.g <= m.v - 3)::INT END), 6) AS share FROM px JOIN o ON o.img = px.img JOIN m ON m.img = px.img AND m.y = px.y AND m.x = px.x CROSS JOIN (VALUES ('fixed'), ('otsu'), ('adaptive')) k(method) GROUP BY label, k.method")

# Composites of transform queries
_T, _TS = transform_queries.QUERIES, transform_queries.ORACLE_SQL


def compose(name: str, build, sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = build, sql


compose("dft_profile_by_class", lambda s, f: _T["dft_radial_profile"](s, f).join(image_queries.images(s, f).select("img", "label"), "img").groupBy("label", "bin").agg(F.round(F.avg("mean_power"), 0).alias("mean_power")), f"SELECT e.label, p.bin, round(avg(p.mean_power), 0) AS mean_power FROM ({_TS['dft_radial_profile']}) p JOIN embeddings e ON e.vec_id = p.img GROUP BY e.label, p.bin")


def feature_row(spark, sf_dir: str) -> DataFrame:
    """The transform features of each image in one row: frequency share, radial profile, compaction, Laplacian variance."""
    radial = _T["dft_radial_profile"](spark, sf_dir).groupBy("img").agg(*[F.max(F.when(F.col("bin") == k, F.col("mean_power"))).alias(f"dft_radial_bin{k}") for k in range(4)])
    return _T["dft_high_frequency"](spark, sf_dir).withColumnRenamed("ratio", "dft_high_freq_ratio").join(radial, "img").join(_T["dct_compaction"](spark, sf_dir), "img").join(image_queries.images(spark, sf_dir).select("img", grids.let(GRID.weighted(F.col("g"), grids.LAPLACE4), variance).alias("laplacian_variance")), "img")


compose("transform_feature_row", feature_row, f"""SELECT h.img, h.ratio AS dft_high_freq_ratio, {', '.join(f'r.dft_radial_bin{k}' for k in range(4))}, c.k1, c.k2, c.k4, l.variance AS laplacian_variance FROM ({_TS['dft_high_frequency']}) h JOIN (SELECT img, {', '.join(f'max(mean_power) FILTER (bin = {k}) AS dft_radial_bin{k}' for k in range(4))} FROM ({_TS['dft_radial_profile']}) q GROUP BY img) r ON r.img = h.img
JOIN ({_TS['dct_compaction']}) c ON c.img = h.img JOIN (WITH {PX}, l AS ({near_sql('px', grids.LAPLACE4, 'sum(V * K)', 'mirror')}) SELECT img, (64 * sum(v * v) - sum(v) * sum(v))::DOUBLE / 4096 AS variance FROM l GROUP BY img) l ON l.img = h.img""")
add("dft_radius_sweep", lambda d: transform_queries.power(d).withColumn("r", transform_queries._radius()).groupBy("img").agg(F.sum("p").alias("all"), *[F.sum(F.when(F.col("r") > k, F.col("p")).otherwise(0.0)).alias(f"s{k}") for k in (1, 2, 3, 4)]).select("img", *[F.round(F.when(F.col("all") > 0, F.col(f"s{k}") / F.col("all")).otherwise(0.0), 6).alias(f"r{k}") for k in (1, 2, 3, 4)]),
    f"WITH {transform_queries._DFT} SELECT img, {', '.join(f'round(CASE WHEN sum(p) > 0 THEN sum(CASE WHEN r > {k} THEN p ELSE 0 END) / sum(p) ELSE 0 END, 6) AS r{k}' for k in (1, 2, 3, 4))} FROM p GROUP BY img")
add("dft_log_magnitude", lambda d: transform_queries.power(d).withColumn("m", F.log1p(F.sqrt("p"))).groupBy("img").agg(F.max("m").alias("top"), F.collect_list(F.struct("u", "v", "m")).alias("l")).select("img", "top", F.explode("l").alias("e")).select("img", "e.u", "e.v", F.when(F.col("top") > 0, F.round(F.col("e.m") / F.greatest("top", F.lit(1e-9)) * 255, 2)).otherwise(0.0).alias("level")),
    f"WITH {transform_queries._DFT}, l AS (SELECT img, u, v, ln(1 + sqrt(p)) AS m FROM p), t AS (SELECT img, max(m) AS top FROM l GROUP BY img) SELECT l.img, CAST(u AS INT) AS u, CAST(v AS INT) AS v, CASE WHEN top > 0 THEN round(m / top * 255, 2) ELSE 0 END AS level FROM l JOIN t ON t.img = l.img")

# Ranking and sampling
compose("cohens_d_ranking", lambda s, f: RELATIONAL["cohens_d"](s, f).orderBy(F.abs("d").desc(), "feature").limit(2), f"SELECT * FROM ({RELATIONAL_SQL['cohens_d']}) q ORDER BY abs(d) DESC, feature LIMIT 2")


def stratified(spark, sf_dir: str) -> DataFrame:
    """At most 20 documents of each language, those with the least hashes: a bounded aggregate, no class in one task."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "doc_id", F.md5(F.col("doc_id").cast("string")).alias("h"))
    dealt = docs.groupBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("part")).agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "doc_id"))), 1, 20).alias("l"))
    return dealt.groupBy("lang").agg(F.slice(F.sort_array(F.flatten(F.collect_list("l"))), 1, 20).alias("l")).select("lang", F.explode("l").alias("e")).select("lang", "e.doc_id")


compose("stratified_sample", stratified, "SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= 20")
