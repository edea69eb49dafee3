"""Face geometry from landmark arrays (structs of x and y in pixels), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places of the six points of each eye (corners first and fourth, lids second with sixth and third with fifth).
LEFT_EYE = (33, 160, 158, 133, 153, 144)
RIGHT_EYE = (362, 385, 387, 263, 373, 380)
#: Upper lip, lower lip, left and right corner of the mouth.
MOUTH = (13, 14, 78, 308)
#: The contour of each eye.
LEFT_CONTOUR = (33, 7, 163, 144, 145, 153, 154, 155, 133, 173, 157, 158, 159, 160, 161, 246)
RIGHT_CONTOUR = (263, 249, 390, 373, 374, 380, 381, 382, 362, 398, 384, 385, 386, 387, 388, 466)


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def ratio(height: Column, width: Column) -> Column:
    """0 where the width vanishes."""
    return F.when(width <= 1e-6, 0.0).otherwise(height / F.greatest(width, F.lit(1e-6)))


def eye_aspect_ratio(points: Column, places: tuple[int, ...]) -> Column:
    """Mean opening of an eye between its lids, against its width."""
    p = [F.get(points, F.lit(i)) for i in places]
    return ratio((distance(p[1], p[5]) + distance(p[2], p[4])) / 2, distance(p[0], p[3]))


def mean_eye_aspect_ratio(points: Column) -> Column:
    return (eye_aspect_ratio(points, LEFT_EYE) + eye_aspect_ratio(points, RIGHT_EYE)) / 2


def mouth_aspect_ratio(points: Column) -> Column:
    top, bottom, left, right = (F.get(points, F.lit(i)) for i in MOUTH)
    return ratio(distance(top, bottom), distance(left, right))


def clipped_box(x0: Column, y0: Column, x1: Column, y1: Column, width: int, height: int) -> Column:
    """A box (x, y, w, h) inside of the frame, one pixel wide and high at least."""

    def side(low: Column, high: Column, n: int) -> tuple[Column, Column]:
        start = F.greatest(F.lit(0), F.least(low, F.lit(n - 1)))
        return start, F.greatest(start + 1, F.least(high, F.lit(n))) - start

    (x, w), (y, h) = side(x0, x1, width), side(y0, y1, height)
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h"))


def eye_box(points: Column, contour: tuple[int, ...], width: int, height: int, margin_x: float = 0.3, margin_y: float = 0.6) -> Column:
    """The box around an eye's contour with margins as shares of its size, clipped to the frame."""
    chosen = F.array(*[F.get(points, F.lit(i)) for i in contour])
    ends = {}
    for axis, margin in (("x", margin_x), ("y", margin_y)):
        values = F.transform(chosen, lambda p: p[axis])  # noqa: B023
        low, high = F.array_min(values), F.array_max(values)
        ends[axis] = (low - (high - low) * margin).cast("int"), (high + (high - low) * margin).cast("int")
    return clipped_box(ends["x"][0], ends["y"][0], ends["x"][1], ends["y"][1], width, height)


def crop(image: Column, width: int, box: Column) -> Column:
    """The gray values of a box of a packed image, row by row; null for boxes under four pixels wide or high."""
    rows = F.flatten(F.transform(F.sequence(box["y"], box["y"] + box["h"] - 1), lambda y: F.slice(image, y * width + box["x"] + 1, box["w"])))
    return F.when((box["w"] >= 4) & (box["h"] >= 4), rows)


def combined_eyes(left: Column, right: Column) -> Column:
    """State and confidence of two eyes, each a struct (closed, confidence) or null: closed if one of them is.

    The confidence is the mean of the eyes that have the state; without any eye the state is null and the confidence 0.
    """
    seen = F.filter(F.array(left, right), lambda e: e.isNotNull())
    closed = F.filter(seen, lambda e: e["closed"])
    speak = F.when(F.size(closed) > 0, closed).otherwise(seen)
    total = F.aggregate(speak, F.lit(0.0), lambda s, e: s + e["confidence"])
    state = F.when(F.size(seen) == 0, F.lit(None).cast("string")).when(F.size(closed) > 0, "closed").otherwise("open")
    return F.struct(state.alias("state"), F.when(F.size(seen) == 0, 0.0).otherwise(total / F.greatest(F.size(speak), F.lit(1))).alias("confidence"))
