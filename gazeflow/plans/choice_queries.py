"""Greedy quota choice, and glare before and after it is filled."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions import grids
from ..operators import frames, inpaint, quota
from ..sources.tables import table
from .codec_queries import MOSAIC_PX

QUOTAS = {"o_orderstatus": {"F": 8, "O": 8, "P": 6}, "o_orderpriority": {"1-URGENT": 9, "5-LOW": 3}}
WEIGHTS, N, CAP = {"o_orderstatus": 5.0, "o_orderpriority": 10.0}, 24, 2


def greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.quota_sample(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", QUOTAS, WEIGHTS, N, CAP)


_OPEN = " + ".join(
    f"CASE {' '.join(f'WHEN c.{col} = {v!r} AND len(list_filter(s.{col}, lambda e: e = {v!r})) < {k} THEN {WEIGHTS[col]}' for v, k in q.items())} ELSE 0 END" for col, q in QUOTAS.items()
)
#: The plain replay over all rows: the state holds what was taken so far.
GREEDY_SQL = f"""WITH RECURSIVE c AS MATERIALIZED (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders),
s AS (SELECT 0 AS step, CAST([] AS BIGINT[]) AS taken, CAST([] AS BIGINT[]) AS subjects, CAST([] AS VARCHAR[]) AS o_orderstatus, CAST([] AS VARCHAR[]) AS o_orderpriority
UNION ALL SELECT step, list_append(taken, k), list_append(subjects, u), list_append(st, v1), list_append(pr, v2) FROM (
  SELECT s.step + 1 AS step, s.taken, s.subjects, s.o_orderstatus AS st, s.o_orderpriority AS pr, c.o_orderkey AS k, c.o_custkey AS u, c.o_orderstatus AS v1, c.o_orderpriority AS v2,
    row_number() OVER (ORDER BY len(list_filter(s.subjects, lambda e: e = c.o_custkey)) < {CAP} DESC, CASE WHEN len(list_filter(s.subjects, lambda e: e = c.o_custkey)) < {CAP} THEN {_OPEN} END DESC, c.h, c.o_orderkey) AS r
  FROM s JOIN c ON NOT list_contains(s.taken, c.o_orderkey) WHERE s.step < {N}) q WHERE r = 1)
SELECT taken[step] AS o_orderkey, subjects[step] AS o_custkey, o_orderstatus[step] AS o_orderstatus, o_orderpriority[step] AS o_orderpriority, CAST(step AS INT) AS step FROM s WHERE step > 0"""


def glare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bright pixels, the mask around them, what stays outside of it, and bright pixels after the mask was filled."""

    def f(stack: np.ndarray):
        cols: dict[str, list] = {k: [] for k in ("n_hot", "n_masked", "rest", "hot_after")}
        for image in stack:
            mask, out = inpaint.glare_mask(image), inpaint.without_glare(image)
            mask &= (image >= 235).any()
            for k, v in zip(cols, ((image >= 235).sum(), mask.sum(), out[~mask].sum(dtype=np.int64), (out >= 235).sum()), strict=True):
                cols[k].append(int(v))
        return cols

    return frames.mapped(frames.mosaics(spark, sf_dir), f, "n_hot bigint, n_masked bigint, rest bigint, hot_after bigint")


_RING = "(VALUES " + ", ".join(f"({dy}, {dx})" for dy, dx, _ in grids.element("ellipse", 7)) + ") n(dy, dx)"
QUERIES = {"greedy_quota": greedy, "glare_before_after": glare}
ORACLE_SQL = {
    "greedy_quota": GREEDY_SQL,
    "glare_before_after": f"""WITH {MOSAIC_PX}, hot AS (SELECT DISTINCT px.img, px.y + n.dy AS y, px.x + n.dx AS x FROM px CROSS JOIN {_RING} WHERE px.g >= 235)
SELECT px.img, count(*) FILTER (g >= 235) AS n_hot, count(hot.img) AS n_masked, CAST(coalesce(sum(g) FILTER (hot.img IS NULL), 0) AS BIGINT) AS rest, CASE WHEN count(hot.img) = 4096 THEN count(*) FILTER (g >= 235) ELSE 0 END AS hot_after
FROM px LEFT JOIN hot ON hot.img = px.img AND hot.y = px.y AND hot.x = px.x GROUP BY px.img""",
}
