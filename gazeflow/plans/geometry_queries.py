"""Queries over landmarks. The fixture makes each place of a 478-point array that an operator reads from two values of an embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import landmarks as lm
from ..sources.tables import images, table

WIDTH, HEIGHT = 640, 480
PLACES = list(dict.fromkeys((*lm.LEFT_CONTOUR, *lm.RIGHT_CONTOUR, *lm.LEFT_EYE, *lm.RIGHT_EYE, *lm.MOUTH)))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, points): 478 points, (0, 0) where no operator looks."""
    number = F.array(*[F.lit(PLACES.index(i) if i in PLACES else -1) for i in range(478)])

    def point(j):
        at = lambda k: F.get("embedding", (j * 2 + k) % 64).cast("double")
        return F.when(j < 0, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))).otherwise(F.struct((at(0) * 512 + 320 + j).alias("x"), (at(1) * 512 + 240 - j).alias("y")))

    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), F.transform(number, point).alias("points"))


def _xy(place: int) -> tuple[str, str]:
    j = PLACES.index(place)
    return f"(embedding[{2 * j % 64 + 1}]::DOUBLE * 512 + 320 + {j})", f"(embedding[{(2 * j + 1) % 64 + 1}]::DOUBLE * 512 + 240 - {j})"


def _far(a: int, b: int) -> str:
    (x, y), (u, v) = _xy(a), _xy(b)
    return f"sqrt(pow({x} - {u}, 2) + pow({y} - {v}, 2))"


def _ear(p: tuple[int, ...]) -> str:
    return f"CASE WHEN {_far(p[0], p[3])} <= 1e-6 THEN 0 ELSE ({_far(p[1], p[5])} + {_far(p[2], p[4])}) / (2 * {_far(p[0], p[3])}) END"


def _box(contour: tuple[int, ...]) -> str:
    xs, ys = ("[" + ", ".join(_xy(i)[k] for i in contour) + "]" for k in (0, 1))
    return f"""SELECT img, greatest(0, least(x0, {WIDTH - 1})) AS x, greatest(0, least(y0, {HEIGHT - 1})) AS y, x1, y1 FROM (SELECT img, CAST(trunc(ax - (bx - ax) * 0.3::DOUBLE) AS INT) AS x0, CAST(trunc(bx + (bx - ax) * 0.3::DOUBLE) AS INT) AS x1,
  CAST(trunc(ay - (b_y - ay) * 0.6::DOUBLE) AS INT) AS y0, CAST(trunc(b_y + (b_y - ay) * 0.6::DOUBLE) AS INT) AS y1
  FROM (SELECT vec_id AS img, list_min({xs}) AS ax, list_max({xs}) AS bx, list_min({ys}) AS ay, list_max({ys}) AS b_y FROM embeddings) e) f"""


def _clip() -> str:
    return f"x, y, CAST(greatest(x + 1, least(x1, {WIDTH})) - x AS INT) AS w, CAST(greatest(y + 1, least(y1, {HEIGHT})) - y AS INT) AS h"


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("points")
    return faces(spark, sf_dir).select("img", F.round(lm.eye_aspect_ratio(p, lm.LEFT_EYE), 6).alias("left_ear"), F.round(lm.eye_aspect_ratio(p, lm.RIGHT_EYE), 6).alias("right_ear"), F.round(lm.mean_eye_aspect_ratio(p), 6).alias("ear"), F.round(lm.mouth_aspect_ratio(p), 6).alias("mar"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = faces(spark, sf_dir).withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right"))))
    box = F.when(F.col("side") == "left", lm.eye_box(F.col("points"), lm.LEFT_CONTOUR, WIDTH, HEIGHT)).otherwise(lm.eye_box(F.col("points"), lm.RIGHT_CONTOUR, WIDTH, HEIGHT))
    return f.select("img", "side", box.alias("b")).select("img", "side", "b.*")


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of the 8 x 8 images by a box that starts at each image's darkest value modulo 6 and may stick out."""
    d = images(spark, sf_dir).withColumn("at", F.array_min("g") % 6)
    cut = d.withColumn("box", lm.clipped_box(F.col("at"), F.col("at") - 2, F.col("at") + 5, F.col("at") + 4, 8, 8))
    pixels = lm.crop(F.col("g"), 8, F.col("box"))
    return cut.select("img", F.size(pixels).alias("n"), F.aggregate(pixels, F.lit(0), lambda a, v: a + v).cast("long").alias("total")).select("img", F.when(F.col("total").isNotNull(), F.col("n")).alias("n"), "total")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of two eyes, one of which may be missing, told by an embedding's first values."""
    eye = lambda i: F.when(F.get("embedding", F.lit(i)) > -0.1, F.struct((F.get("embedding", F.lit(i)) < 0).alias("closed"), F.abs(F.get("embedding", F.lit(i + 2)).cast("double")).alias("confidence")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), lm.combined_eyes(eye(0), eye(1)).alias("e")).select("img", "e.state", F.round("e.confidence", 6).alias("confidence"))


QUERIES = {"landmark_ratios": ratios, "eye_boxes": boxes, "eye_crops": crops, "combined_eyes": states}

ORACLE_SQL = {
    "landmark_ratios": f"""SELECT vec_id AS img, round({_ear(lm.LEFT_EYE)}, 6) AS left_ear, round({_ear(lm.RIGHT_EYE)}, 6) AS right_ear, round((({_ear(lm.LEFT_EYE)}) + ({_ear(lm.RIGHT_EYE)})) / 2, 6) AS ear,
  round(CASE WHEN {_far(lm.MOUTH[2], lm.MOUTH[3])} <= 1e-6 THEN 0 ELSE {_far(lm.MOUTH[0], lm.MOUTH[1])} / {_far(lm.MOUTH[2], lm.MOUTH[3])} END, 6) AS mar FROM embeddings""",
    "eye_boxes": f"SELECT img, 'left' AS side, {_clip()} FROM ({_box(lm.LEFT_CONTOUR)}) l UNION ALL SELECT img, 'right' AS side, {_clip()} FROM ({_box(lm.RIGHT_CONTOUR)}) r",
    "eye_crops": """WITH px AS (SELECT vec_id AS img, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, CAST(greatest(0, least(255, floor(CAST(embedding[i] AS DOUBLE) * 256 + 128))) AS INT) AS g FROM embeddings, range(1, 65) t(i)),
a AS (SELECT img, min(g) % 6 AS k FROM px GROUP BY img), b AS (SELECT img, greatest(0, least(k, 7)) AS x, greatest(0, least(k - 2, 7)) AS y, k FROM a), c AS (SELECT img, x, y, greatest(x + 1, least(k + 5, 8)) AS x1, greatest(y + 1, least(k + 4, 8)) AS y1 FROM b)
SELECT c.img, CAST(CASE WHEN x1 - c.x >= 4 AND y1 - c.y >= 4 THEN count(*) END AS INT) AS n, CAST(CASE WHEN x1 - c.x >= 4 AND y1 - c.y >= 4 THEN sum(g) END AS BIGINT) AS total
FROM c JOIN px ON px.img = c.img AND px.x >= c.x AND px.x < x1 AND px.y >= c.y AND px.y < y1 GROUP BY c.img, c.x, c.y, x1, y1""",
    "combined_eyes": """WITH e AS (SELECT vec_id AS img, embedding[i] < 0 AS closed, abs(embedding[i + 2]::DOUBLE) AS c, embedding[i] > CAST(-0.1 AS DOUBLE) AS seen FROM embeddings, range(1, 3) t(i)),
s AS (SELECT img, count(*) FILTER (seen) AS n, count(*) FILTER (seen AND closed) AS k, avg(c) FILTER (seen) AS c_all, avg(c) FILTER (seen AND closed) AS c_closed FROM e GROUP BY img)
SELECT img, CASE WHEN n = 0 THEN NULL WHEN k > 0 THEN 'closed' ELSE 'open' END AS state, round(CASE WHEN n = 0 THEN 0 WHEN k > 0 THEN c_closed ELSE c_all END, 6) AS confidence FROM s""",
}
