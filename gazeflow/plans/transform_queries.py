"""Frequency transforms, block compression and quadtree queries over the 8 x 8 fixture."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grids import let
from ..sources.tables import images
from .image_queries import PX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The luminance quantisation table of the JPEG standard (annex K), row by row.
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
#: Orthonormal cosine basis: row u, column x.
COSINE = [[math.sqrt((1 if u == 0 else 2) / 8) * math.cos(math.pi * (2 * x + 1) * u / 16) for x in range(8)] for u in range(8)]


def add(name: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(images(spark, sf_dir))
    ORACLE_SQL[name] = sql


def scaled_table(quality: int) -> list[int]:
    """The quantisation table for a quality from 1 to 100."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [max(1, min(255, (v * scale + 50) // 100)) for v in LUMINANCE]


def product(a: Column, b: Column, n: int = 8) -> Column:
    """Product of two n x n matrices held row by row."""

    def one(i: Column) -> Column:
        r, c = F.floor(i / n).cast("int"), (i % n).cast("int")
        total = F.lit(0.0)
        for k in range(n):
            total = total + F.get(a, r * n + k) * F.get(b, F.lit(k * n) + c)
        return total

    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), one)


def constant(matrix: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in matrix])


BASIS, BACK = [v for row in COSINE for v in row], [COSINE[u][x] for x in range(8) for u in range(8)]


def transformed(d: DataFrame) -> DataFrame:
    """Adds ``c``, the coefficients of the two-dimensional cosine transform."""
    basis, back = constant(BASIS), constant(BACK)
    inner = lambda b, k: let(product(b, F.transform("g", lambda v: v.cast("double"))), lambda t: product(t, k))
    return d.withColumn("c", let(basis, lambda b: let(back, lambda k: inner(b, k))))


def inverse(d: DataFrame, coefficients: Column) -> DataFrame:
    """Adds ``r``, the image of the given coefficients, rounded and clipped."""
    inner = lambda b, k: let(coefficients, lambda c: let(product(k, c), lambda t: product(t, b)))
    values = let(constant(BASIS), lambda b: let(constant(BACK), lambda k: inner(b, k)))
    return d.withColumn("r", F.transform(values, lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.round(v, 6) + 0.5))).cast("int")))


_COS = "b AS (SELECT u, x, sqrt((CASE WHEN u = 0 THEN 1 ELSE 2 END) / 8.0::DOUBLE) * cos(pi() * (2 * x + 1) * u / 16) AS b FROM range(0, 8) p(u), range(0, 8) q(x))"
_DCT = f"{PX}, {_COS}, t AS (SELECT px.img, b.u, px.x, sum(b.b * px.g) AS t FROM px JOIN b ON b.x = px.y GROUP BY px.img, b.u, px.x), c AS (SELECT t.img, t.u, b.u AS v, sum(b.b * t.t) AS c FROM t JOIN b ON b.x = t.x GROUP BY t.img, t.u, b.u)"


def inverse_sql(source: str) -> str:
    return f"ri AS (SELECT s.img, b.x AS y, s.v, sum(b.b * s.k) AS t FROM {source} s JOIN b ON b.u = s.u GROUP BY s.img, b.x, s.v), rr AS (SELECT r.img, r.y, b.x, CAST(greatest(0, least(255, floor(round(sum(b.b * r.t), 6) + 0.5))) AS INT) AS r FROM ri r JOIN b ON b.u = r.v GROUP BY r.img, r.y, b.x)"


def coefficients(d: DataFrame) -> DataFrame:
    rows = transformed(d).select("img", F.posexplode("c").alias("i", "c"))
    return rows.select("img", F.floor(F.col("i") / 8).cast("int").alias("u"), (F.col("i") % 8).cast("int").alias("v"), (F.round("c", 4) + 0.0).alias("c"))


add("dct_coefficients", coefficients, f"WITH {_DCT} SELECT img, CAST(u AS INT) AS u, CAST(v AS INT) AS v, round(c, 4) + 0.0 AS c FROM c")


def compaction(d: DataFrame) -> DataFrame:
    """Share of the energy in the lowest k x k coefficients."""
    m = transformed(d).withColumn("e", F.transform("c", lambda v: v * v)).withColumn("n", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    shares = [F.round(F.when(F.col("n") > 0, sum((F.get("e", F.lit(8 * u + v)) for u in range(k) for v in range(k)), F.lit(0.0)) / F.col("n")).otherwise(0.0), 6).alias(f"k{k}") for k in (1, 2, 4)]
    return m.select("img", *shares)


add("dct_compaction", compaction, f"WITH {_DCT} SELECT img, " + ", ".join(f"round(CASE WHEN sum(c * c) > 0 THEN coalesce(sum(c * c) FILTER (u < {k} AND v < {k}), 0) / sum(c * c) ELSE 0 END, 6) AS k{k}" for k in (1, 2, 4)) + " FROM c GROUP BY img")

for _q in (10, 50, 90):
    _values = "qt AS (SELECT * FROM (VALUES " + ", ".join(f"({i // 8}, {i % 8}, {v})" for i, v in enumerate(LUMINANCE)) + f") l(u, v, base)), q AS (SELECT u, v, greatest(1, least(255, (base * {5000 // _q if _q < 50 else 200 - 2 * _q} + 50) // 100)) AS q FROM qt)"
    _quant = f"{_DCT}, {_values}, z AS (SELECT c.img, c.u, c.v, q.q, round(round((c.c - CASE WHEN c.u = 0 AND c.v = 0 THEN 1024 ELSE 0 END) / q.q, 6)) AS n FROM c JOIN q ON q.u = c.u AND q.v = c.v)"

    def reconstructed(d: DataFrame, q: int = _q) -> DataFrame:
        """Error of the image after its coefficients were quantised."""
        m = transformed(d).withColumn("q", constant(scaled_table(q))).withColumn("c", F.transform("c", lambda v, i: F.when(i == 0, v - 1024).otherwise(v)))
        m = m.withColumn("n", F.zip_with("c", "q", lambda c, k: F.round(F.round(c / k, 6))))
        out = inverse(m, F.transform(F.zip_with("n", "q", lambda n, k: n * k), lambda v, i: F.when(i == 0, v + 1024).otherwise(v)))
        error = F.aggregate(F.zip_with("g", "r", lambda a, b: (a - b) * (a - b)), F.lit(0), lambda s, v: s + v) / 64
        zero = F.size(F.filter("n", lambda v: v == 0))
        return out.select("img", F.round(error, 4).alias("mse"), zero.cast("long").alias("n_zero"))

    add(f"dct_quantised_{_q}", reconstructed, f"WITH {_quant}, s AS (SELECT img, u, v, n * q + CASE WHEN u = 0 AND v = 0 THEN 1024 ELSE 0 END AS k FROM z), {inverse_sql('s')} SELECT px.img, round(avg((px.g - rr.r) * (px.g - rr.r)), 4) AS mse, any_value(y.n) AS n_zero FROM px JOIN rr ON rr.img = px.img AND rr.y = px.y AND rr.x = px.x JOIN (SELECT img, count(*) FILTER (n = 0) AS n FROM z GROUP BY img) y ON y.img = px.img GROUP BY px.img")

    def entropy(d: DataFrame, q: int = _q) -> DataFrame:
        """Bits a pixel by the entropy of the quantised coefficients of all images."""
        m = transformed(d).withColumn("q", constant(scaled_table(q))).withColumn("c", F.transform("c", lambda v, i: F.when(i == 0, v - 1024).otherwise(v)))
        n = m.select(F.explode(F.zip_with("c", "q", lambda c, k: F.round(F.round(c / k, 6)) + 0.0)).alias("n")).groupBy("n").agg(F.count("*").alias("k"))
        return n.agg(F.sum("k").alias("total"), F.sum(F.col("k") * F.log2("k")).alias("s")).select(F.round(F.log2("total") - F.col("s") / F.col("total"), 6).alias("bits_per_pixel"))

    add(f"dct_entropy_{_q}", entropy, f"WITH {_quant}, h AS (SELECT n + 0.0 AS n, count(*) AS k FROM z GROUP BY 1) SELECT round(log2(sum(k)) - sum(k * log2(k)) / sum(k), 6) AS bits_per_pixel FROM h")


def top_left(d: DataFrame, k: int = 4) -> DataFrame:
    m = transformed(d)
    out = inverse(m, F.transform("c", lambda v, i: F.when((F.floor(i / 8) < k) & (i % 8 < k), v).otherwise(0.0)))
    return out.select("img", F.round(F.aggregate(F.zip_with("g", "r", lambda a, b: (a - b) * (a - b)), F.lit(0), lambda s, v: s + v) / 64, 4).alias("mse"))


add("dct_topk_4", top_left, f"WITH {_DCT}, s AS (SELECT img, u, v, CASE WHEN u < 4 AND v < 4 THEN c ELSE 0 END AS k FROM c), {inverse_sql('s')} SELECT px.img, round(avg((px.g - rr.r) * (px.g - rr.r)), 4) AS mse FROM px JOIN rr ON rr.img = px.img AND rr.y = px.y AND rr.x = px.x GROUP BY px.img")


def power(d: DataFrame) -> DataFrame:
    """Power of the shifted Fourier transform: (img, u, v, p); the zero frequency is at (4, 4)."""
    wave = [[2 * math.pi * ((u - 4) % 8) * x / 8 for x in range(8)] for u in range(8)]
    cos, sin = ([f(wave[u][x]) for u in range(8) for x in range(8)] for f in (math.cos, math.sin))
    turn = lambda m: [m[u * 8 + x] for x in range(8) for u in range(8)]
    m = d.withColumn("a", F.transform("g", lambda v: v.cast("double")))
    for name, matrix in (("rc", cos), ("rs", sin), ("cc", turn(cos)), ("cs", turn(sin))):
        m = m.withColumn(name, constant(matrix))
    re = lambda yc, ys: F.zip_with(product(yc, F.col("cc")), product(ys, F.col("cs")), lambda a, b: a - b)
    im = lambda yc, ys: F.zip_with(product(yc, F.col("cs")), product(ys, F.col("cc")), lambda a, b: a + b)
    total = let(product(F.col("rc"), F.col("a")), lambda yc: let(product(F.col("rs"), F.col("a")), lambda ys: F.zip_with(re(yc, ys), im(yc, ys), lambda a, b: a * a + b * b)))
    rows = m.select("img", F.posexplode(total).alias("i", "p"))
    return rows.select("img", F.floor(F.col("i") / 8).cast("int").alias("u"), (F.col("i") % 8).cast("int").alias("v"), "p")


_DFT = f"""{PX}, w AS (SELECT img, u, v, sum(g * cos(2 * pi() * ((u - 4) * y + (v - 4) * x) / 8)) AS re, sum(g * sin(2 * pi() * ((u - 4) * y + (v - 4) * x) / 8)) AS im FROM px, range(0, 8) a(u), range(0, 8) b(v) GROUP BY img, u, v),
p AS (SELECT img, u, v, re * re + im * im AS p, sqrt(((u - 4) * (u - 4) + (v - 4) * (v - 4))::DOUBLE) AS r FROM w)"""
def _radius() -> Column:
    """Distance from the zero frequency."""
    return F.sqrt(((F.col("u") - 4) * (F.col("u") - 4) + (F.col("v") - 4) * (F.col("v") - 4)).cast("double"))


add("dft_power", lambda d: power(d).select("img", "u", "v", (F.round("p", 2) + 0.0).alias("p")), f"WITH {_DFT} SELECT img, CAST(u AS INT) AS u, CAST(v AS INT) AS v, round(p, 2) + 0.0 AS p FROM p")
add("dft_high_frequency", lambda d: power(d).groupBy("img").agg(F.round(F.when(F.sum("p") > 0, F.sum(F.when(_radius() > 2, F.col("p")).otherwise(0.0)) / F.sum("p")).otherwise(0.0), 6).alias("ratio")), f"WITH {_DFT} SELECT img, round(CASE WHEN sum(p) > 0 THEN sum(CASE WHEN r > 2 THEN p ELSE 0 END) / sum(p) ELSE 0 END, 6) AS ratio FROM p GROUP BY img")
add("dft_radial_profile", lambda d: power(d).withColumn("bin", F.least(F.lit(3), F.floor(_radius() / 1.25)).cast("int")).groupBy("img", "bin").agg(F.round(F.avg("p"), 2).alias("mean_power")), f"WITH {_DFT} SELECT img, CAST(least(3, floor(r / 1.25)) AS INT) AS bin, round(avg(p), 2) AS mean_power FROM p GROUP BY 1, 2")


def quadtree(d: DataFrame, threshold: int = 60, least: int = 2) -> DataFrame:
    """Leaves of a quadtree that splits blocks whose range of values is above the threshold, down to a least size."""
    rows = d.select("img", F.posexplode("g").alias("i", "g")).withColumn("y", F.floor(F.col("i") / 8).cast("int")).withColumn("x", (F.col("i") % 8).cast("int"))
    blocks = None
    for size in (8, 4, 2):
        own = rows.groupBy("img", F.floor(F.col("y") / size).cast("int").alias("by"), F.floor(F.col("x") / size).cast("int").alias("bx")).agg((F.max("g") - F.min("g")).alias("range"), F.floor(F.avg("g")).cast("int").alias("mean")).withColumn("size", F.lit(size))
        blocks = own if blocks is None else blocks.unionByName(own)
    even = (F.col("range") <= threshold) | (F.col("size") <= least)
    # a block is a leaf if it is even and none of those around it is
    around = blocks.where(even).select("img", F.col("size").alias("s"), F.col("by").alias("y"), F.col("bx").alias("x"))
    up = [blocks["size"] < around["s"], F.floor(F.col("by") * F.col("size") / F.col("s")) == F.col("y"), F.floor(F.col("bx") * F.col("size") / F.col("s")) == F.col("x")]
    return blocks.where(even).join(around, [blocks["img"] == around["img"], *up], "left_anti").select("img", (F.col("by") * F.col("size")).alias("y"), (F.col("bx") * F.col("size")).alias("x"), "size", "mean")


add("region_quadtree", quadtree, f"""WITH RECURSIVE {PX}, q AS (SELECT DISTINCT img, 0 AS y, 0 AS x, 8 AS size FROM px
UNION ALL SELECT q.img, q.y + dy * q.size // 2, q.x + dx * q.size // 2, q.size // 2 FROM q CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(dy, dx)
  WHERE q.size > 2 AND (SELECT max(g) - min(g) FROM px WHERE px.img = q.img AND px.y >= q.y AND px.y < q.y + q.size AND px.x >= q.x AND px.x < q.x + q.size) > 60),
s AS (SELECT q.img, q.y, q.x, q.size, max(g) - min(g) AS r, CAST(floor(avg(g)) AS INT) AS mean FROM q JOIN px ON px.img = q.img AND px.y >= q.y AND px.y < q.y + q.size AND px.x >= q.x AND px.x < q.x + q.size GROUP BY ALL)
SELECT img, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(size AS INT) AS size, mean FROM s WHERE r <= 60 OR size <= 2""")


def adjacency(d: DataFrame, tolerance: int = 15) -> DataFrame:
    """Pairs of quadtree leaves that touch, and how many of them may merge, by image. An image has at most 16 leaves."""
    leaves = quadtree(d)
    a, b = (leaves.select("img", *(F.col(c).alias(f"{c}{s}") for c in ("y", "x", "size", "mean"))) for s in "ab")
    before = (F.col("ya") < F.col("yb")) | ((F.col("ya") == F.col("yb")) & (F.col("xa") < F.col("xb")))
    meet = lambda p: (F.col(f"{p}a") < F.col(f"{p}b") + F.col("sizeb")) & (F.col(f"{p}b") < F.col(f"{p}a") + F.col("sizea"))
    touch = lambda p: (F.col(f"{p}a") + F.col("sizea") == F.col(f"{p}b")) | (F.col(f"{p}b") + F.col("sizeb") == F.col(f"{p}a"))
    pairs = a.join(b, "img").where(before & ((touch("y") & meet("x")) | (touch("x") & meet("y"))))
    return pairs.groupBy("img").agg(F.count("*").alias("n_adjacent"), F.count_if(F.abs(F.col("meana") - F.col("meanb")) <= tolerance).alias("n_mergeable"))


add("region_adjacency", adjacency, f"""WITH RECURSIVE {ORACLE_SQL['region_quadtree'].removeprefix('WITH RECURSIVE ').rpartition('SELECT img, CAST(y')[0]}, l AS (SELECT * FROM s WHERE r <= 60 OR size <= 2),
p AS (SELECT a.img, abs(a.mean - b.mean) AS gap FROM l a JOIN l b ON a.img = b.img AND (a.y, a.x) < (b.y, b.x)
  AND (((a.y + a.size = b.y OR b.y + b.size = a.y) AND a.x < b.x + b.size AND b.x < a.x + a.size) OR ((a.x + a.size = b.x OR b.x + b.size = a.x) AND a.y < b.y + b.size AND b.y < a.y + a.size)))
SELECT img, count(*) AS n_adjacent, count(*) FILTER (gap <= 15) AS n_mergeable FROM p GROUP BY img""")
