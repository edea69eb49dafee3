"""Filters, thresholds, transforms and circles on images of 64 x 64 pixels: numpy on stacks in Spark, pixels and joins in the SQL twin."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grids
from ..operators import filters, frames, spectra
from .codec_queries import MOSAIC_PX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(frames.mosaics(spark, sf_dir))
    ORACLE_SQL[name] = sql


def near(source: str, kernel: grids.Kernel, aggregate: str, border: str = "mirror", column: str = "g") -> str:
    """A stencil on images of 64 x 64 by joining pixels with their neighbours."""
    rule = {"mirror": "63 - abs(63 - abs({}))", "clamp": "greatest(0, least(63, {}))"}[border]
    values = ", ".join(f"({dy}, {dx}, {k})" for dy, dx, k in kernel)
    place = f"SELECT c.img, c.y, c.x, {rule.format('c.y + n.dy')} AS ny, {rule.format('c.x + n.dx')} AS nx, n.k FROM {source} c CROSS JOIN (VALUES {values}) n(dy, dx, k)"
    return f"WITH place AS MATERIALIZED ({place}) SELECT c.img, c.y, c.x, CAST({aggregate.replace('V', 'p.' + column).replace('K', 'c.k')} AS INT) AS v FROM place c JOIN {source} p ON p.img = c.img AND p.y = c.ny AND p.x = c.nx GROUP BY c.img, c.y, c.x"


def stats(df: DataFrame, image: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(img, total, squares, mixed) of what a filter makes of each image; ``mixed`` weighs pixels by their places, so it tells wrong places."""

    def f(stack: np.ndarray):
        out = image(stack).astype(np.int64)
        place = np.arange(out[0].size).reshape(out.shape[1:]) % 97
        return {"total": out.sum((1, 2)), "squares": (out * out).sum((1, 2)), "mixed": (out * place).sum((1, 2))}

    return frames.mapped(df, f, "total bigint, squares bigint, mixed bigint")


_STATS = "SELECT img, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * v) AS BIGINT) AS squares, CAST(sum(v * ((y * 64 + x) % 97)) AS BIGINT) AS mixed FROM ({}) q GROUP BY img"
for _size in (3, 5):
    _n = _size * _size
    add(f"mosaic_mean_{_size}", lambda d, k=_size: stats(d, lambda s: filters.mean(s, k)), f"WITH {MOSAIC_PX} " + _STATS.format(near("px", grids.box(_size), f"floor((sum(V) * 2 + {_n}) / {2 * _n}.0)")))
    add(f"mosaic_gauss_{_size}", lambda d, k=_size: stats(d, lambda s: filters.gauss(s, k)), f"WITH {MOSAIC_PX} " + _STATS.format(near("px", grids.binomial(_size), f"floor((sum(V * K) * 2 + {4 ** (_size - 1)}) / {2 * 4 ** (_size - 1)}.0)")))
    add(f"mosaic_median_{_size}", lambda d, k=_size: stats(d, lambda s: filters.median(s, k)), f"WITH {MOSAIC_PX} " + _STATS.format(near("px", grids.box(_size), "median(V)", "clamp")))

_OTSU = """h AS (SELECT img, g, count(*) AS n, sum(g) AS s FROM px GROUP BY img, g), cum AS (SELECT img, g AS t, sum(n) OVER w AS n0, sum(s) OVER w AS s0, sum(n) OVER (PARTITION BY img) AS n, sum(s) OVER (PARTITION BY img) AS s FROM h WINDOW w AS (PARTITION BY img ORDER BY g)),
o AS (SELECT img, t FROM cum QUALIFY row_number() OVER (PARTITION BY img ORDER BY round(CASE WHEN n0 < n THEN pow(s0::DOUBLE * n - s::DOUBLE * n0, 2) / (n0::DOUBLE * (n - n0)) ELSE -1 END, 6) DESC, t) = 1)"""


def thresholds(df: DataFrame) -> DataFrame:
    def f(stack: np.ndarray):
        t = filters.otsu(stack)
        return {"threshold": t, "dark": (stack <= t[:, None, None]).sum((1, 2))}

    return frames.mapped(df, f, "threshold int, dark bigint")


add("mosaic_otsu", thresholds, f"WITH {MOSAIC_PX}, {_OTSU} SELECT px.img, CAST(any_value(t) AS INT) AS threshold, count(*) FILTER (g <= t) AS dark FROM px JOIN o ON o.img = px.img GROUP BY px.img")

_CFG = spectra.CircleSearch()
_EDGES = f"""med AS ({near('px', grids.box(5), 'median(V)', 'clamp')}), gx AS ({near('med', grids.SOBEL_X, 'sum(V * K)', column='v')}), gy AS ({near('med', grids.SOBEL_Y, 'sum(V * K)', column='v')}),
gr AS MATERIALIZED (SELECT gx.img, gx.y, gx.x, gx.v AS gx, gy.v AS gy, abs(gx.v) + abs(gy.v) AS size FROM gx JOIN gy ON gy.img = gx.img AND gy.y = gx.y AND gy.x = gx.x),
step AS (SELECT *, CASE WHEN abs(gy) * 5 <= abs(gx) * 2 THEN 0 ELSE 1 END AS dy, CASE WHEN abs(gy) * 5 <= abs(gx) * 2 THEN 1 WHEN abs(gx) * 5 <= abs(gy) * 2 THEN 0 WHEN gx * gy >= 0 THEN 1 ELSE -1 END AS dx FROM gr),
weak AS MATERIALIZED (SELECT s.img, s.y, s.x, s.gx, s.gy, s.size FROM step s LEFT JOIN gr a ON a.img = s.img AND a.y = s.y - s.dy AND a.x = s.x - s.dx LEFT JOIN gr b ON b.img = s.img AND b.y = s.y + s.dy AND b.x = s.x + s.dx
  WHERE s.size >= {_CFG.high // 2} AND s.size > coalesce(a.size, 0) AND s.size >= coalesce(b.size, 0)),
reach AS (SELECT img, y, x FROM weak WHERE size >= {_CFG.high} UNION SELECT w.img, w.y, w.x FROM reach r CROSS JOIN (VALUES {', '.join(f'({dy}, {dx})' for dy, dx, _ in grids.SQUARE)}) n(dy, dx) JOIN weak w ON w.img = r.img AND w.y = r.y + n.dy AND w.x = r.x + n.dx),
edge AS MATERIALIZED (SELECT w.* FROM weak w JOIN reach r ON r.img = w.img AND r.y = w.y AND r.x = w.x),
vote AS MATERIALIZED (SELECT img, cy, cx, count(*) AS votes FROM (SELECT img, floor(round(y + side * r * gy::DOUBLE / sqrt((gx * gx + gy * gy)::DOUBLE), 9) + 0.5) AS cy, floor(round(x + side * r * gx::DOUBLE / sqrt((gx * gx + gy * gy)::DOUBLE), 9) + 0.5) AS cx
  FROM edge CROSS JOIN range({_CFG.low_radius}, {_CFG.top_radius + 1}) q(r) CROSS JOIN (VALUES (-1), (1)) k(side)) WHERE cy BETWEEN 0 AND 63 AND cx BETWEEN 0 AND 63 GROUP BY img, cy, cx)"""
_CIRCLES = f"""top AS (SELECT v.img, v.cy, v.cx, v.votes FROM vote v LEFT JOIN vote a ON a.img = v.img AND a.cy = v.cy AND a.cx = v.cx - 1 LEFT JOIN vote b ON b.img = v.img AND b.cy = v.cy - 1 AND b.cx = v.cx LEFT JOIN vote c ON c.img = v.img AND c.cy = v.cy AND c.cx = v.cx + 1 LEFT JOIN vote d ON d.img = v.img AND d.cy = v.cy + 1 AND d.cx = v.cx
  WHERE v.votes >= {_CFG.votes} AND v.votes > coalesce(a.votes, 0) AND v.votes > coalesce(b.votes, 0) AND v.votes >= coalesce(c.votes, 0) AND v.votes >= coalesce(d.votes, 0)),
ring AS (SELECT img, cy, cx, votes, r, count(*) AS k FROM (SELECT t.img, t.cy, t.cx, t.votes, floor(sqrt((e.y - t.cy) * (e.y - t.cy) + (e.x - t.cx) * (e.x - t.cx)) + 0.5) AS r FROM top t JOIN edge e ON e.img = t.img) WHERE r BETWEEN {_CFG.low_radius} AND {_CFG.top_radius} GROUP BY img, cy, cx, votes, r),
fit AS (SELECT * FROM ring QUALIFY row_number() OVER (PARTITION BY img, cy, cx ORDER BY round(k / r, 9) DESC, r) = 1),
good AS MATERIALIZED (SELECT img, cy, cx, r, row_number() OVER (PARTITION BY img ORDER BY votes DESC, cy, cx) AS i FROM fit WHERE k >= {_CFG.votes}),
pick AS (SELECT img, i, [struct_pack(cy := cy, cx := cx, r := r)] AS l FROM good WHERE i = 1
  UNION ALL SELECT g.img, g.i, CASE WHEN len(list_filter(p.l, lambda c: (c.cy - g.cy) * (c.cy - g.cy) + (c.cx - g.cx) * (c.cx - g.cx) < {_CFG.apart**2})) > 0 THEN p.l ELSE list_append(p.l, struct_pack(cy := g.cy, cx := g.cx, r := g.r)) END FROM pick p JOIN good g ON g.img = p.img AND g.i = p.i + 1),
circle AS (SELECT m.img, coalesce(p.l, []) AS l FROM (SELECT DISTINCT img FROM px) m LEFT JOIN (SELECT img, l FROM pick QUALIFY row_number() OVER (PARTITION BY img ORDER BY i DESC) = 1) p ON p.img = m.img),
hough AS (SELECT img, CAST(len(l) > 0 AS INT) AS hough_found, coalesce(l[1].cx, 0) AS hough_cx, coalesce(l[1].cy, 0) AS hough_cy, coalesce(l[1].r, 0) AS hough_radius, CAST(len(l) AS INT) AS hough_n_circles FROM circle)"""


def vote_table(df: DataFrame) -> DataFrame:
    """Cells that reach the least number of votes for a centre."""

    def f(stack: np.ndarray):
        total, _ = spectra.votes(stack)
        i, y, x = np.nonzero(total >= _CFG.votes)
        return i, {"cy": y, "cx": x, "votes": total[i, y, x]}

    return frames.exploded(df, f, "cy int, cx int, votes bigint")


add("hough_votes", vote_table, f"WITH RECURSIVE {MOSAIC_PX}, {_EDGES} SELECT img, CAST(cy AS INT) AS cy, CAST(cx AS INT) AS cx, votes FROM vote WHERE votes >= {_CFG.votes}")

_SPECTRUM = """wave AS MATERIALIZED (SELECT u, x, cos(2 * pi() * (u * x % 64) / 64) AS c, sin(2 * pi() * (u * x % 64) / 64) AS s, sqrt((CASE WHEN u = 0 THEN 1 ELSE 2 END) / 64.0::DOUBLE) * cos(pi() * ((2 * x + 1) * u % 256) / 128) AS d FROM range(0, 64) p(u), range(0, 64) q(x)),
half AS MATERIALIZED (SELECT img, y, w.u AS v, sum(g * c) AS c, sum(g * s) AS s, sum(g * d) AS d FROM px JOIN wave w ON w.x = px.x GROUP BY img, y, w.u),
freq AS MATERIALIZED (SELECT img, w.u, v, pow(sum(h.c * w.c - h.s * w.s), 2) + pow(sum(h.c * w.s + h.s * w.c), 2) AS p, pow(sum(h.d * w.d), 2) AS e FROM half h JOIN wave w ON w.x = h.y GROUP BY img, w.u, v),
ring_p AS (SELECT *, sqrt(CAST(((u + 32) % 64 - 32) * ((u + 32) % 64 - 32) + ((v + 32) % 64 - 32) * ((v + 32) % 64 - 32) AS DOUBLE)) AS r FROM freq)"""
_RADIAL = "(" + " + ".join(f"CAST(r >= {i * float(np.sqrt(2048.0)) / 8!r}::DOUBLE AS INT)" for i in range(1, 8)) + ")"
_ROW = f"""spec AS (SELECT img, CASE WHEN sum(p) > 0 THEN coalesce(sum(p) FILTER (r > 8), 0) / sum(p) ELSE 0 END AS dft_high_freq_ratio, {', '.join(f'avg(p) FILTER ({_RADIAL} = {i}) AS dft_radial_bin{i}' for i in range(8))},
{', '.join(f'CASE WHEN sum(e) > 0 THEN sum(e) FILTER (u < {k} AND v < {k}) / sum(e) ELSE 0 END AS dct_compaction_k{k}' for k in spectra.COMPACTION)} FROM ring_p GROUP BY img),
lap AS (SELECT img, (4096 * sum(v * v) - sum(v) * sum(v))::DOUBLE / 16777216 AS laplacian_variance FROM ({near('px', grids.LAPLACE4, 'sum(V * K)')}) q GROUP BY img)"""


def feature_table(df: DataFrame) -> DataFrame:
    """All 19 columns of each image in one pass over its pixels."""
    rows = frames.mapped(df, spectra.feature_rows, spectra.SCHEMA)
    rounded = lambda c: F.round(c, 1 if "radial" in c else 6) if "dft" in c or "dct" in c else F.col(c)
    return rows.select("img", *[rounded(c).alias(c) for c in spectra.COLUMNS])


add("transform_columns", feature_table, f"WITH RECURSIVE {MOSAIC_PX}, {_EDGES}, {_CIRCLES}, {_SPECTRUM}, {_ROW} SELECT s.img, {', '.join(f'round({c}, {1 if chr(114) + chr(97) + chr(100) in c else 6}) AS {c}' for c in spectra.COLUMNS[:13])}, laplacian_variance, h.* EXCLUDE (img) FROM spec s JOIN lap l ON l.img = s.img JOIN hough h ON h.img = s.img")


def detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of images with a circle, and mean radius of those, by class."""
    rows = frames.mapped(frames.mosaics(spark, sf_dir).withColumn("class", (F.col("label") % 2).cast("int")), lambda s: {k: v for k, v in spectra.feature_rows(s).items() if k in ("hough_found", "hough_radius")}, "hough_found int, hough_radius double", keys=("img", "class"))
    return rows.groupBy("class").agg(F.count("*").alias("n"), F.round(F.avg("hough_found"), 6).alias("rate"), F.round(F.avg(F.when(F.col("hough_found") == 1, F.col("hough_radius"))), 6).alias("mean_radius"))


QUERIES["hough_by_class"], ORACLE_SQL["hough_by_class"] = detection, f"WITH RECURSIVE {MOSAIC_PX}, {_EDGES}, {_CIRCLES} SELECT CAST(k.label % 2 AS INT) AS class, count(*) AS n, round(avg(hough_found), 6) AS rate, round(avg(hough_radius) FILTER (hough_found = 1), 6) AS mean_radius FROM hough h JOIN (SELECT vec_id // 64 AS img, min_by(label, vec_id) AS label FROM embeddings GROUP BY 1) k ON k.img = h.img GROUP BY 1"
