"""Split and merge, growth in order, merging by dilation, shapes and cleaned masks: numpy on stacks in Spark, recursive joins in the SQL twin."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grids
from ..operators import frames, regions
from .codec_queries import MOSAIC_PX
from .image_queries import _MASK, _REACH, PX, near_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

THRESHOLDS, LEAST, TOLERANCE, GROWTH = (80, 120, 160), 4, 15, 45


def split_merge(df: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS, least: int = LEAST, tolerance: float = TOLERANCE) -> DataFrame:
    """Leaves and regions of each image for each threshold of the split."""

    def f(stack: np.ndarray):
        n = len(stack)
        cols: dict[str, list] = {"threshold": [], "n_leaves": [], "n_regions": []}
        for t in thresholds:
            rows, _, region, _ = regions.split_merge(stack, least, t, tolerance)
            cols["threshold"] += [t] * n
            cols["n_leaves"] += np.bincount(rows[:, 0], minlength=n).tolist()
            cols["n_regions"] += np.bincount(rows[np.unique(region), 0], minlength=n).tolist()
        return np.tile(np.arange(n), len(thresholds)), cols

    return frames.exploded(df, f, "threshold int, n_leaves bigint, n_regions bigint")


QUERIES["split_merge_counts"] = lambda spark, sf_dir: split_merge(frames.mosaics(spark, sf_dir))
ORACLE_SQL["split_merge_counts"] = f"""WITH RECURSIVE {MOSAIC_PX},
level AS MATERIALIZED (SELECT img, s.size, y // s.size AS rb, x // s.size AS cb, max(g) - min(g) AS span, avg(g) AS mean FROM px CROSS JOIN (VALUES (64), (32), (16), (8), ({LEAST})) s(size) GROUP BY ALL),
quad AS (SELECT t.threshold, level.* FROM level CROSS JOIN (VALUES {', '.join(f'({t})' for t in THRESHOLDS)}) t(threshold) WHERE size = 64
  UNION ALL SELECT q.threshold, l.* FROM quad q JOIN level l ON l.img = q.img AND l.size * 2 = q.size AND l.rb // 2 = q.rb AND l.cb // 2 = q.cb WHERE q.span > q.threshold AND q.size > {LEAST}),
leaf AS MATERIALIZED (SELECT threshold, img, size, rb * size AS y, cb * size AS x, mean, row_number() OVER (PARTITION BY threshold, img ORDER BY rb * size, cb * size) AS i FROM quad WHERE span <= threshold OR size <= {LEAST}),
near AS MATERIALIZED (SELECT a.threshold, a.img, a.i, b.i AS j FROM leaf a JOIN leaf b ON a.threshold = b.threshold AND a.img = b.img AND a.i <> b.i WHERE abs(a.mean - b.mean) <= {TOLERANCE}
  AND (((a.y + a.size = b.y OR b.y + b.size = a.y) AND a.x < b.x + b.size AND b.x < a.x + a.size) OR ((a.x + a.size = b.x OR b.x + b.size = a.x) AND a.y < b.y + b.size AND b.y < a.y + a.size))),
reach AS (SELECT threshold, img, i, i AS r FROM leaf UNION SELECT n.threshold, n.img, n.j, r.r FROM reach r JOIN near n ON n.threshold = r.threshold AND n.img = r.img AND n.i = r.i)
SELECT img, CAST(threshold AS INT) AS threshold, count(*) AS n_leaves, count(DISTINCT r) AS n_regions FROM (SELECT threshold, img, i, min(r) AS r FROM reach GROUP BY ALL) q GROUP BY img, threshold"""


def growth(df: DataFrame, tolerance: float = GROWTH, eight: bool = False, running: bool = False) -> DataFrame:
    """(img, y, x, rank): when each pixel joins the region of the darkest one."""

    def f(stack: np.ndarray):
        w = stack.shape[2]
        ranks = np.stack([regions.growth_ranks(image, divmod(int(image.argmin()), w), tolerance, eight, running) for image in stack])
        i, y, x = np.nonzero(ranks >= 0)
        return i, {"y": y, "x": x, "rank": ranks[i, y, x]}

    return frames.exploded(df, f, "y int, x int, rank int")


QUERIES["region_growth_ranks"] = lambda spark, sf_dir: growth(frames.small_images(spark, sf_dir))
_STEPS = "(VALUES " + ", ".join(f"('{i}', {dy}, {dx})" for i, (dy, dx) in enumerate(regions.FOUR)) + ") n(i, dy, dx)"
_GROWN = f"""WITH RECURSIVE {PX}, seed AS (SELECT img, y, x, g FROM px QUALIFY row_number() OVER (PARTITION BY img ORDER BY g, y, x) = 1),
free AS MATERIALIZED (SELECT px.img, px.y, px.x FROM px JOIN seed s ON s.img = px.img WHERE abs(px.g - s.g) <= {GROWTH}),
walk AS (SELECT img, y, x, 0 AS k FROM seed UNION SELECT f.img, f.y, f.x, w.k + 1 FROM walk w CROSS JOIN {_STEPS} JOIN free f ON f.img = w.img AND f.y = w.y + n.dy AND f.x = w.x + n.dx WHERE w.k < 63),
far AS MATERIALIZED (SELECT img, y, x, min(k) AS k FROM walk GROUP BY ALL),
way AS (SELECT img, y, x, k, '' AS path FROM far WHERE k = 0 UNION ALL SELECT f.img, f.y, f.x, f.k, min(w.path || n.i) AS path FROM way w CROSS JOIN {_STEPS} JOIN far f ON f.img = w.img AND f.y = w.y + n.dy AND f.x = w.x + n.dx AND f.k = w.k + 1 GROUP BY f.img, f.y, f.x, f.k)"""
ORACLE_SQL["region_growth_ranks"] = f"{_GROWN} SELECT img, y, x, CAST(row_number() OVER (PARTITION BY img ORDER BY k, path) - 1 AS INT) AS rank FROM way"
QUERIES["region_growth_snapshots"] = lambda spark, sf_dir: growth(frames.small_images(spark, sf_dir)).withColumn("pixels", F.explode(F.array(*map(F.lit, (2, 4, 8, 16))))).where("rank < pixels").groupBy("img", "pixels").agg(F.count("*").alias("n"), F.sum(F.col("y") * 8 + F.col("x")).alias("places"))
ORACLE_SQL["region_growth_snapshots"] = f"{_GROWN}, r AS (SELECT img, y, x, row_number() OVER (PARTITION BY img ORDER BY k, path) - 1 AS rank FROM way) SELECT img, CAST(t.pixels AS INT) AS pixels, count(*) AS n, CAST(sum(y * 8 + x) AS BIGINT) AS places FROM r CROSS JOIN (VALUES (2), (4), (8), (16)) t(pixels) WHERE rank < t.pixels GROUP BY img, t.pixels"


def merging(df: DataFrame) -> DataFrame:
    """Components of the dark mask, and the dilations by a square after which two of them, and all, have joined."""

    def f(stack: np.ndarray):
        count, first, last = regions.merge_steps(stack < 120)
        none = lambda v: [None if x < 0 else x for x in v.tolist()]
        return {"n_components": count, "first_merge": none(first), "single": none(last)}

    return frames.mapped(df, f, "n_components bigint, first_merge int, single int")


QUERIES["mask_merge_steps"] = lambda spark, sf_dir: merging(frames.small_images(spark, sf_dir))
ORACLE_SQL["mask_merge_steps"] = f"""WITH RECURSIVE {PX}, {_MASK}, {_REACH.format('')},
far AS MATERIALIZED (SELECT p.img, p.y, p.x, min(greatest(abs(p.y - q.y), abs(p.x - q.x))) AS d FROM mask p JOIN mask q ON q.img = p.img AND q.g = 1 GROUP BY p.img, p.y, p.x),
spread AS (SELECT a.img, k.k, a.l, a.l // 8 AS y, a.l % 8 AS x FROM a CROSS JOIN range(0, 8) k(k) UNION SELECT f.img, s.k, s.l, f.y, f.x FROM spread s JOIN far f ON f.img = s.img AND f.d <= s.k AND abs(f.y - s.y) <= 1 AND abs(f.x - s.x) <= 1),
n AS (SELECT img, k, count(DISTINCT m) AS n FROM (SELECT s.img, s.k, a.l, min(s.l) AS m FROM spread s JOIN a ON a.img = s.img AND a.l // 8 = s.y AND a.l % 8 = s.x GROUP BY ALL) q GROUP BY img, k)
SELECT e.vec_id AS img, coalesce(max(n.n) FILTER (n.k = 0), 0) AS n_components, CAST(min(n.k) FILTER (n.n < z.n) AS INT) AS first_merge, CAST(coalesce(min(n.k) FILTER (n.k > 0 AND n.n = 1), CASE WHEN count(n.k) = 0 THEN 1 END) AS INT) AS single
FROM embeddings e LEFT JOIN n ON n.img = e.vec_id LEFT JOIN n z ON z.img = e.vec_id AND z.k = 0 GROUP BY e.vec_id"""


def shapes(df: DataFrame) -> DataFrame:
    """The 14 shape columns and the compactness of dark masks."""
    names = (*regions.SHAPE, "compactness")
    rows = frames.mapped(df, lambda stack: regions.shape_rows((stack < 120).astype(np.int64)), ", ".join(f"{c} double" for c in names))
    return rows.select("img", *[F.round(c, 6).alias(c) for c in names])


_CLOCK = "(VALUES " + ", ".join(f"({i}, {dy}, {dx})" for i, (dy, dx) in enumerate(regions.CLOCK)) + ") t(turn, dy, dx)"
QUERIES["mask_shape_columns"] = lambda spark, sf_dir: shapes(frames.small_images(spark, sf_dir))
ORACLE_SQL["mask_shape_columns"] = f"""WITH RECURSIVE {PX}, {_MASK}, {_REACH.format('')},
best AS (SELECT img, l, n FROM a QUALIFY row_number() OVER (PARTITION BY img ORDER BY n DESC, l) = 1), one AS MATERIALIZED (SELECT c.img, c.y, c.x FROM c JOIN best b ON b.img = c.img AND b.l = c.l),
m AS (SELECT img, count(*) AS n, avg(y) AS cy, avg(x) AS cx, var_pop(y) + 1 / 12.0::DOUBLE AS a, var_pop(x) + 1 / 12.0::DOUBLE AS c, covar_pop(y, x) AS b, max(y) - min(y) + 1 AS h, max(x) - min(x) + 1 AS w FROM one GROUP BY img),
free AS MATERIALIZED (SELECT b.img, CAST(p.y AS INT) AS y, CAST(q.x AS INT) AS x FROM best b CROSS JOIN range(-1, 9) p(y) CROSS JOIN range(-1, 9) q(x) LEFT JOIN one o ON o.img = b.img AND o.y = p.y AND o.x = q.x WHERE o.img IS NULL),
air AS (SELECT img, y, x FROM free WHERE y = -1 AND x = -1 UNION SELECT f.img, f.y, f.x FROM air r JOIN free f ON f.img = r.img AND abs(f.y - r.y) <= 1 AND abs(f.x - r.x) <= 1),
filled AS (SELECT img, 64 - count(*) FILTER (y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7) AS filled FROM air GROUP BY img),
ends AS MATERIALIZED (SELECT DISTINCT img, 2 * y + s.dy AS y, 2 * x + s.dx AS x FROM one CROSS JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(dy, dx)),
side AS MATERIALIZED (SELECT img, y, min(x) AS low, max(x) AS top FROM ends GROUP BY img, y),
chord AS (SELECT p.img, r.r, min(CASE WHEN p.y = q.y THEN p.low ELSE p.low + (q.low - p.low) * (r.r - p.y)::DOUBLE / (q.y - p.y) END) AS low, max(CASE WHEN p.y = q.y THEN p.top ELSE p.top + (q.top - p.top) * (r.r - p.y)::DOUBLE / (q.y - p.y) END) AS top
  FROM range(0, 16, 2) r(r) JOIN side p ON p.y <= r.r JOIN side q ON q.img = p.img AND q.y >= r.r GROUP BY p.img, r.r),
convex AS (SELECT img, sum(floor(top / 2 + 1e-9) - ceil(low / 2 - 1e-9) + 1) AS convex FROM chord GROUP BY img),
turns AS MATERIALIZED (SELECT o.img, o.y, o.x, d.side, t.turn, o.y + t.dy AS ny, o.x + t.dx AS nx FROM one o CROSS JOIN range(0, 8) d(side) CROSS JOIN {_CLOCK} JOIN one p ON p.img = o.img AND p.y = o.y + t.dy AND p.x = o.x + t.dx QUALIFY row_number() OVER (PARTITION BY o.img, o.y, o.x, d.side ORDER BY (t.turn - d.side + 7) % 8) = 1),
path AS (SELECT t.img, 0 AS k, t.y, t.x, t.turn, t.ny, t.nx, t.y AS y0, t.x AS x0, t.turn AS t0 FROM turns t JOIN best b ON b.img = t.img AND b.l = t.y * 8 + t.x WHERE t.side = 4
  UNION ALL SELECT t.img, p.k + 1, t.y, t.x, t.turn, t.ny, t.nx, y0, x0, t0 FROM path p JOIN turns t ON t.img = p.img AND t.y = p.ny AND t.x = p.nx AND t.side = (p.turn + 4) % 8 WHERE NOT (t.y = y0 AND t.x = x0 AND t.turn = t0)),
round_ AS (SELECT img, count(*) FILTER (turn % 2 = 0) + count(*) FILTER (turn % 2 = 1) * sqrt(2) AS length, abs(sum(x * ny - nx * y)) / 2 AS area FROM path GROUP BY img),
count_ AS (SELECT img, count(*) AS parts, sum(n) AS dark FROM a GROUP BY img)
SELECT e.vec_id AS img, coalesce(k.parts, 0)::DOUBLE AS n_components, round(coalesce(k.dark, 0) / 64, 6) AS dark_area_ratio, coalesce(m.n, 0)::DOUBLE AS largest_area, round(coalesce(m.n, 0) / 64, 6) AS largest_area_ratio, coalesce(f.filled, 0)::DOUBLE AS filled_area, round(coalesce(f.filled, 0) / 64, 6) AS filled_area_ratio,
  round(coalesce(cy, 0) / 8, 6) AS centroid_row_norm, round(coalesce(cx, 0) / 8, 6) AS centroid_col_norm, round(coalesce(sqrt(greatest(0, 1 - ((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b)) / ((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b)))), 0), 6) AS eccentricity,
  round(coalesce(m.n / v.convex, 0), 6) AS solidity, round(coalesce(m.n / (h * w), 0), 6) AS extent, round(coalesce(w / h, 0), 6) AS bbox_aspect_ratio, round(coalesce(h, 0) / 8, 6) AS vertical_extent_norm, CASE WHEN m.img IS NULL THEN 1 ELSE 0 END::DOUBLE AS is_degenerate, round(coalesce(4 * pi() * r.area / (r.length * r.length), 0), 6) AS compactness
FROM embeddings e LEFT JOIN m ON m.img = e.vec_id LEFT JOIN count_ k ON k.img = e.vec_id LEFT JOIN filled f ON f.img = e.vec_id LEFT JOIN convex v ON v.img = e.vec_id LEFT JOIN round_ r ON r.img = e.vec_id"""


def cleaned(df: DataFrame) -> DataFrame:
    """Pixels of dark masks after opening by an ellipse of 3, closing by one of 5 and filling of holes, and the sum of their places."""

    def f(stack: np.ndarray):
        m = regions.opened_closed((stack < 120).astype(np.int64), grids.element("ellipse", 3), grids.element("ellipse", 5))
        return {"area": m.sum((1, 2)), "places": (m * np.arange(m[0].size).reshape(m.shape[1:])).sum((1, 2))}

    return frames.mapped(df, f, "area bigint, places bigint")


QUERIES["mask_clean_chain"] = lambda spark, sf_dir: cleaned(frames.small_images(spark, sf_dir))
_E3, _E5 = grids.element("ellipse", 3), grids.element("ellipse", 5)
ORACLE_SQL["mask_clean_chain"] = f"""WITH RECURSIVE {PX}, {_MASK}, m1 AS MATERIALIZED ({near_sql('mask', _E3, 'min(V)', 'drop')}), m2 AS MATERIALIZED ({near_sql('m1', _E3, 'max(V)', 'drop', 'v')}), m3 AS MATERIALIZED ({near_sql('m2', _E5, 'max(V)', 'drop', 'v')}), m4 AS MATERIALIZED ({near_sql('m3', _E5, 'min(V)', 'drop', 'v')}),
air AS (SELECT img, y, x FROM m4 WHERE v = 0 AND (y IN (0, 7) OR x IN (0, 7)) UNION SELECT f.img, f.y, f.x FROM air r JOIN m4 f ON f.img = r.img AND f.v = 0 AND abs(f.y - r.y) + abs(f.x - r.x) = 1)
SELECT m4.img, count(*) FILTER (air.img IS NULL) AS area, CAST(coalesce(sum(m4.y * 8 + m4.x) FILTER (air.img IS NULL), 0) AS BIGINT) AS places FROM m4 LEFT JOIN air ON air.img = m4.img AND air.y = m4.y AND air.x = m4.x GROUP BY m4.img"""
