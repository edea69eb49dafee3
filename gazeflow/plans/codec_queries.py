"""JPEG files of images of 64 x 64: sizes, errors and likeness by quality, with the files themselves written and read back."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames, jpeg, quality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Pixels of the mosaics: 64 embeddings each, missing tiles 128.
MOSAIC_PX = """tile AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
px AS MATERIALIZED (SELECT vec_id // 64 AS img, CAST(vec_id % 64 // 8 * 8 + i // 8 AS INT) AS y, CAST(vec_id % 8 * 8 + i % 8 AS INT) AS x, CAST(greatest(0, least(255, floor(CAST(v AS DOUBLE) * 256 + 128))) AS INT) AS g FROM tile
  UNION ALL SELECT m.img, CAST(t // 8 * 8 + i // 8 AS INT), CAST(t % 8 * 8 + i % 8 AS INT), 128 FROM (SELECT DISTINCT vec_id // 64 AS img FROM embeddings) m CROSS JOIN range(0, 64) p(t) CROSS JOIN range(0, 64) q(i) WHERE m.img * 64 + t NOT IN (SELECT vec_id FROM embeddings))"""


def sweep(df: DataFrame, qualities: tuple[int, ...] = jpeg.QUALITIES, keep: bool = False) -> DataFrame:
    """Every image at every quality: codes, bits and bytes of its file, error and likeness of what is read back from it.

    (img, quality, n_codes, n_bits, n_bytes, bpp, mse, psnr, ssim, file); ``file`` is null unless ``keep``, psnr is infinite for
    equal images, ssim is null for images under 7 pixels.
    """

    def f(stack: np.ndarray):
        n, h, w = stack.shape
        rows: dict[str, list] = {k: [] for k in ("quality", "n_codes", "n_bits", "n_bytes", "mse", "ssim", "file")}
        made = [jpeg.encode(stack, q) for q in qualities]
        read = iter(jpeg.decode([file for files, _, _ in made for file in files]))  # as many steps as the longest file has codes, not that many for each quality
        for q, (files, codes, bits) in zip(qualities, made, strict=True):
            back = np.stack([next(read) for _ in files])
            rows["quality"] += [q] * n
            rows["n_codes"] += codes.tolist()
            rows["n_bits"] += bits.tolist()
            rows["n_bytes"] += map(len, files)
            rows["mse"] += quality.mse(stack, back).tolist()
            rows["ssim"] += quality.ssim(stack, back).tolist() if min(h, w) >= 7 else [None] * n
            rows["file"] += files if keep else [None] * n
        rows["bpp"] = [8 * v / (h * w) for v in rows["n_bytes"]]
        rows["psnr"] = quality.psnr(np.array(rows["mse"])).tolist()
        return np.tile(np.arange(n), len(qualities)), rows

    return frames.exploded(df, f, "quality int, n_codes bigint, n_bits bigint, n_bytes bigint, bpp double, mse double, psnr double, ssim double, file binary")


def rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep(frames.mosaics(spark, sf_dir)).select("img", "quality", "n_codes", "n_bits", "n_bytes", F.round("bpp", 6).alias("bpp"), F.round("mse", 6).alias("mse"))


def by_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over all images; infinite ratios are left out of theirs."""
    return sweep(frames.mosaics(spark, sf_dir)).groupBy("quality").agg(
        F.count("*").alias("n"), F.round(F.avg("n_bytes"), 4).alias("mean_bytes"), F.round(F.avg("bpp"), 6).alias("mean_bpp"), F.round(F.avg("n_bytes") / 1024, 6).alias("mean_kb"),
        F.round(F.avg(F.when(F.col("psnr") < float("inf"), F.col("psnr"))), 4).alias("mean_psnr"), F.round(F.avg("ssim"), 5).alias("mean_ssim"), F.round(F.avg("n_bytes") / 1024 * 30, 4).alias("kb_per_s"),
    )


def _table(codes: tuple[np.ndarray, np.ndarray], symbols: list[int]) -> str:
    return "(VALUES " + ", ".join(f"({s}, '{codes[0][s]:0{codes[1][s]}b}')" for s in symbols) + ") h(symbol, code)"


_QUALITY = "(VALUES " + ", ".join(f"({q})" for q in jpeg.QUALITIES) + ") k(quality)"
_COEFFICIENTS = f"""{MOSAIC_PX}, b AS MATERIALIZED (SELECT u, x, sqrt((CASE WHEN u = 0 THEN 1 ELSE 2 END) / 8.0::DOUBLE) * cos(pi() * (2 * x + 1) * u / 16) AS b FROM range(0, 8) p(u), range(0, 8) q(x)),
ct AS (SELECT img, px.y // 8 * 8 + px.x // 8 AS block, b.u, px.x % 8 AS x, sum(b.b * (g - 128)) AS t FROM px JOIN b ON b.x = px.y % 8 GROUP BY 1, 2, 3, 4),
c AS MATERIALIZED (SELECT img, block, ct.u, b.u AS v, sum(b.b * ct.t) AS c FROM ct JOIN b ON b.x = ct.x GROUP BY ALL),
zq AS (SELECT * FROM (VALUES {', '.join(f'({i // 8}, {i % 8}, {v}, {k})' for i, v, k in zip(range(64), jpeg.LUMINANCE.ravel().tolist(), np.argsort(jpeg.ZIGZAG).tolist(), strict=True))}) l(u, v, base, place)),
z AS MATERIALIZED (SELECT img, quality, block, c.u, c.v, place, q, CAST(round(round(c / q, 6)) AS BIGINT) AS n FROM c JOIN (SELECT quality, u, v, place, greatest(1, least(255, (base * CASE WHEN quality < 50 THEN 5000 // quality ELSE 200 - 2 * quality END + 50) // 100)) AS q FROM zq CROSS JOIN {_QUALITY}) q ON q.u = c.u AND q.v = c.v)"""
_BITS = f"""size AS (SELECT img, quality, block, place, n, CASE WHEN n = 0 THEN 0 ELSE length(bin(abs(n))) END AS s FROM
  (SELECT img, quality, block, place, CASE WHEN place = 0 THEN n - lag(n, 1, 0) OVER (PARTITION BY img, quality, place ORDER BY block) ELSE n END AS n FROM z)),
ev AS (SELECT img, quality, block, place, place - lag(place, 1, 0) OVER (PARTITION BY img, quality, block ORDER BY place) - 1 AS run, n, s FROM size WHERE n <> 0 AND place > 0),
code AS (SELECT img, quality, block, place, 1 AS n_codes, h.code || CASE WHEN s = 0 THEN '' ELSE lpad(bin(CASE WHEN n > 0 THEN n ELSE n + (1 << s) - 1 END), CAST(s AS INT), '0') END AS t FROM size JOIN {_table(jpeg.MEAN, jpeg.MEAN_SYMBOLS)} ON h.symbol = s WHERE place = 0
UNION ALL SELECT img, quality, block, place, 1 + run // 16, repeat('{jpeg.OTHER[0][0xF0]:0{jpeg.OTHER[1][0xF0]}b}', run // 16) || h.code || lpad(bin(CASE WHEN n > 0 THEN n ELSE n + (1 << s) - 1 END), CAST(s AS INT), '0') FROM ev JOIN {_table(jpeg.OTHER, jpeg.OTHER_SYMBOLS)} ON h.symbol = run % 16 * 16 + s
UNION ALL SELECT img, quality, block, 64, 1, '{jpeg.OTHER[0][0]:0{jpeg.OTHER[1][0]}b}' FROM z WHERE place = 63 AND n = 0),
scan AS (SELECT img, quality, sum(n_codes) AS n_codes, string_agg(t, '' ORDER BY block, place) AS t FROM code GROUP BY img, quality),
padded AS (SELECT img, quality, n_codes, length(t) AS n_bits, t || repeat('1', (8 - length(t) % 8) % 8) AS t FROM scan),
file AS (SELECT img, quality, CAST(n_codes AS BIGINT) AS n_codes, n_bits, {len(jpeg.head(jpeg.LUMINANCE, 64, 64)) + 2} + length(t) // 8 + len(list_filter(range(0, length(t) // 8), lambda i: substr(t, i * 8 + 1, 8) = '11111111')) AS n_bytes FROM padded)"""
_BACK = """it AS (SELECT img, quality, block, b.x AS y, v, sum(b.b * n * q) AS t FROM z JOIN b ON b.u = z.u GROUP BY ALL),
back AS MATERIALIZED (SELECT img, quality, block // 8 * 8 + it.y AS y, block % 8 * 8 + b.x AS x, CAST(greatest(0, least(255, floor(round(sum(b.b * it.t), 6) + 128.5))) AS INT) AS r FROM it JOIN b ON b.u = it.v GROUP BY ALL)"""
_ERROR = "error AS (SELECT px.img, quality, avg((g - r) * (g - r)) AS mse FROM px JOIN back ON back.img = px.img AND back.y = px.y AND back.x = px.x GROUP BY px.img, quality)"

QUERIES["jpeg_rate"], ORACLE_SQL["jpeg_rate"] = rate, f"WITH {_COEFFICIENTS}, {_BITS}, {_BACK}, {_ERROR} SELECT file.img, file.quality, n_codes, n_bits, n_bytes, round(n_bytes / 512, 6) AS bpp, round(mse, 6) AS mse FROM file JOIN error ON error.img = file.img AND error.quality = file.quality"

_WINDOW = ", ".join(f"sum({{}}{c}) OVER (PARTITION BY img, quality, {{other}} ORDER BY {{along}} ROWS 6 PRECEDING) AS {c}".replace("{}", "{p}") for c in ("a", "b", "aa", "bb", "ab"))
_SSIM = f"""v AS (SELECT px.img, quality, px.y, px.x, g AS a, r AS b, g * g AS aa, r * r AS bb, g * r AS ab FROM px JOIN back ON back.img = px.img AND back.y = px.y AND back.x = px.x),
v1 AS (SELECT img, quality, y, x, {_WINDOW.format(p='', other='y', along='x')} FROM v), v2 AS (SELECT img, quality, y, x, {_WINDOW.format(p='', other='x', along='y')} FROM v1 WHERE x >= 6),
s AS (SELECT img, quality, a / 49 AS ma, b / 49 AS mb, (aa / 49 - (a / 49) * (a / 49)) * 49 / 48 AS va, (bb / 49 - (b / 49) * (b / 49)) * 49 / 48 AS vb, (ab / 49 - (a / 49) * (b / 49)) * 49 / 48 AS cov FROM v2 WHERE y >= 6),
ssim AS (SELECT img, quality, avg((2 * ma * mb + 6.5025::DOUBLE) * (2 * cov + 58.5225::DOUBLE) / ((ma * ma + mb * mb + 6.5025::DOUBLE) * (va + vb + 58.5225::DOUBLE))) AS ssim FROM s GROUP BY img, quality)"""
QUERIES["jpeg_quality_sweep"], ORACLE_SQL["jpeg_quality_sweep"] = by_quality, f"""WITH {_COEFFICIENTS}, {_BITS}, {_BACK}, {_ERROR}, {_SSIM} SELECT f.quality, count(*) AS n, round(avg(n_bytes), 4) AS mean_bytes, round(avg(n_bytes / 512), 6) AS mean_bpp, round(avg(n_bytes) / 1024, 6) AS mean_kb,
round(avg(10 * log10(65025 / mse)) FILTER (mse > 0), 4) AS mean_psnr, round(avg(ssim), 5) AS mean_ssim, round(avg(n_bytes) / 1024 * 30, 4) AS kb_per_s FROM file f JOIN error e ON e.img = f.img AND e.quality = f.quality JOIN ssim s ON s.img = f.img AND s.quality = f.quality GROUP BY f.quality"""


def scaled_round(v: Column, places: int) -> Column:
    """Doubles rounded as the SQL twin does it: scaled, rounded half away from zero and scaled back.

    ``F.round`` rounds the decimal text of a double, which goes the other way where a product misses a half by its last bit.
    """
    return F.round(v * float(10**places)) / float(10**places)


def bandwidth(spark: SparkSession, sf_dir: str, fps: int = 30) -> DataFrame:
    """Kilobytes a second that frames of each quality take."""
    return by_quality(spark, sf_dir).select("quality", scaled_round(F.col("mean_kb") * fps, 4).alias("kb_per_s"))


QUERIES["bandwidth"], ORACLE_SQL["bandwidth"] = bandwidth, f"SELECT quality, round(mean_kb * 30, 4) AS kb_per_s FROM ({ORACLE_SQL['jpeg_quality_sweep']}) q"
