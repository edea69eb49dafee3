"""Resampling of packed images: each axis is a list of (target, source, weight), so a target pixel is a weighted sum."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grids import clipped

Axis = list[tuple[int, int, float]]


def _merged(parts: list[tuple[int, int, float]]) -> Axis:
    out: dict[tuple[int, int], float] = {}
    for t, s, w in parts:
        out[t, s] = out.get((t, s), 0.0) + w
    return [(t, s, w) for (t, s), w in sorted(out.items()) if w]


def axis(source: int, target: int, kind: str) -> Axis:
    """``nearest``, ``area`` (mean of the source under a target pixel), ``linear`` or ``cubic`` (a = -0.75) with clamped borders."""
    scale, parts = source / target, []
    for t in range(target):
        if kind == "nearest":
            parts.append((t, min(source - 1, int(t * scale)), 1.0))
        elif kind == "area":
            low, high = t * scale, (t + 1) * scale
            for s in range(int(low), min(source, math.ceil(high))):
                parts.append((t, s, (min(high, s + 1) - max(low, s)) / scale))
        else:
            at = (t + 0.5) * scale - 0.5
            base, part = math.floor(at), at - math.floor(at)
            if kind == "linear":
                weights = {0: 1 - part, 1: part}
            else:
                a = -0.75
                weights = {}
                for k in (-1, 0, 1, 2):
                    d = abs(part - k)
                    weights[k] = ((a + 2) * d - (a + 3)) * d * d + 1 if d <= 1 else ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
            parts += [(t, max(0, min(source - 1, base + k)), w) for k, w in weights.items()]
    return _merged(parts)


def resized(image: Column, width: int, rows: Axis, columns: Axis) -> Column:
    """The image resampled along both axes, rounded half up and clipped."""
    taps: dict[tuple[int, int], list[dict]] = {}
    for y, sy, wy in rows:
        for x, sx, wx in columns:
            taps.setdefault((y, x), []).append({"i": sy * width + sx, "w": wy * wx})
    table = F.from_json(F.lit(json.dumps([taps[k] for k in sorted(taps)])), "array<array<struct<i:int,w:double>>>")  # a constant
    return F.transform(table, lambda t: clipped(F.floor(F.round(F.aggregate(t, F.lit(0.0), lambda s, e: s + F.get(image, e["i"]) * e["w"]), 6) + 0.5)))


def letterboxed(image: Column, height: int, width: int, size: int, fill: int = 0) -> Column:
    """The image scaled by area to fit a square, in the middle of it, the rest filled."""
    h, w = max(1, round(size * height / max(height, width))), max(1, round(size * width / max(height, width)))
    small = resized(image, width, axis(height, h, "area"), axis(width, w, "area"))
    top, left = (size - h) // 2, (size - w) // 2
    inside = lambda y, x: 0 <= y - top < h and 0 <= x - left < w
    return F.transform(F.array(small), lambda m: F.array(*[F.get(m, F.lit((y - top) * w + x - left)) if inside(y, x) else F.lit(fill) for y in range(size) for x in range(size)]))[0]
