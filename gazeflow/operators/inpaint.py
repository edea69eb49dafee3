"""Glare suppression and the whole preparation of an eye image."""

from __future__ import annotations

import functools
import heapq
import math
from dataclasses import dataclass

import numpy as np

from ..functions.grids import element
from . import packed
from .masks import shifted

FAR = 1e6


def inpaint(image: np.ndarray, mask: np.ndarray, radius: int = 5) -> np.ndarray:
    """Fill a mask from its rim inwards, nearest places first.

    Distances to the rim grow by fast marching: the pixel with the least distance is fixed next (the earlier row and column of
    equal ones) and gives its open neighbours theirs. A pixel is filled when it is fixed, by the mean of the known pixels within
    ``radius``, each continued along its gradient. Weights favour the direction of the distance's change, near pixels and
    those at the same distance to the rim. Without any known pixel the image stays as it is.
    """
    mask = mask.astype(bool)
    if mask.all() or not mask.any():
        return image.copy()
    r, (h, w) = radius + 1, image.shape
    value, known = np.pad(image.astype(float), r), np.pad(~mask, r)  # nothing is known outside
    inside = np.pad(np.ones((h, w), bool), r)
    far, fixed = np.where(known, 0.0, FAR), known.copy()
    dy, dx = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    size = (dy * dy + dx * dx).astype(float)
    ring = (size > 0) & (size <= radius * radius)
    size[radius, radius] = 1.0
    down, right = np.zeros_like(value), np.zeros_like(value)
    queue: list[tuple[float, int, int]] = []

    def slope(of: np.ndarray, ok: np.ndarray, y: int, x: int) -> tuple[float, float]:
        """Change of ``of`` downwards and to the right at a place, from those neighbours that are ``ok``."""
        out = []
        for ey, ex in ((1, 0), (0, 1)):
            after, before = bool(ok[y + ey, x + ex]), bool(ok[y - ey, x - ex])
            high, low = of[y + ey, x + ex] if after else of[y, x], of[y - ey, x - ex] if before else of[y, x]
            out.append((high - low) / max(1, after + before))
        return out[0], out[1]

    def tell(places: list[tuple[int, int]]) -> None:
        """Gradients of known pixels whose surroundings have changed."""
        for y, x in places:
            down[y, x], right[y, x] = slope(value, known, y, x)

    def open_around(y: int, x: int) -> None:
        """Distances of the open neighbours, from what is fixed across and along: |grad T| = 1 on the grid."""
        for a, b in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
            if inside[a, b] and not fixed[a, b]:
                p, q = (min(far[i, j] if fixed[i, j] else FAR for i, j in two) for two in (((a, b - 1), (a, b + 1)), ((a - 1, b), (a + 1, b))))
                t = (p + q + math.sqrt(2 - (p - q) ** 2)) / 2 if abs(p - q) < 1 else 1 + min(p, q)
                if t < far[a, b]:
                    far[a, b] = t
                    heapq.heappush(queue, (float(t), a, b))

    y, x = np.nonzero(known)
    for out, ey, ex in ((down, 1, 0), (right, 0, 1)):
        after, before = known[y + ey, x + ex], known[y - ey, x - ex]
        high, low = np.where(after, value[y + ey, x + ex], value[y, x]), np.where(before, value[y - ey, x - ex], value[y, x])
        out[y, x] = (high - low) / np.maximum(1, after.astype(int) + before)
    rim = known & (shifted((inside & ~known)[None], 0, 1, 0) | shifted((inside & ~known)[None], 0, -1, 0) | shifted((inside & ~known)[None], 1, 0, 0) | shifted((inside & ~known)[None], -1, 0, 0))[0]
    for y, x in np.argwhere(rim).tolist():
        open_around(y, x)
    while queue:
        t, y, x = heapq.heappop(queue)
        if fixed[y, x] or t > far[y, x]:
            continue
        at = np.s_[y - radius : y + radius + 1, x - radius : x + radius + 1]
        ty, tx = slope(far, far < FAR, y, x)
        k = np.where(ring & known[at], np.maximum(np.abs(dy * ty + dx * tx) / np.sqrt(size), 1e-6) / size / (1 + np.abs(far[at] - t)), 0.0)
        if (weight := k.sum()) > 0:
            filled = (k * (value[at] - down[at] * dy - right[at] * dx)).sum() / weight
            beside = value[y - 1 : y + 2, x - 1 : x + 2][known[y - 1 : y + 2, x - 1 : x + 2]]
            # no continued gradient leaves the range beside the pixel
            value[y, x] = filled.clip(beside.min(), beside.max()) if len(beside) else filled.clip(0, 255)
        fixed[y, x] = known[y, x] = True
        tell([p for p in ((y, x), (y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)) if known[p]])
        open_around(y, x)
    return np.floor(np.round(value[r:-r, r:-r], 6) + 0.5).clip(0, 255).astype(np.uint8)


def glare_mask(image: np.ndarray, threshold: int = 235, grow: int = 3) -> np.ndarray:
    """Pixels from ``threshold`` on, with what lies within an ellipse of ``grow`` around them."""
    hot = (image >= threshold).astype(np.int64)[None]
    out = hot
    for dy, dx, _ in element("ellipse", 2 * grow + 1) if grow else ():
        out = np.maximum(out, shifted(hot, dy, dx, 0))
    return out[0] > 0


def without_glare(image: np.ndarray, threshold: int = 235, grow: int = 3, radius: int = 5) -> np.ndarray:
    """The image with its glare filled from around; as it is without any pixel so bright, or if nothing else is left."""
    mask = glare_mask(image, threshold, grow) if (image >= threshold).any() else None
    return image if mask is None or mask.all() else inpaint(image, mask, radius)


@dataclass(frozen=True)
class Preparation:
    """How an eye image is prepared: its size (letterboxed or not), glare, gamma, and equalisation by tiles."""

    size: int = 64
    letterbox: bool = False
    glare: bool = True
    threshold: int = 235
    grow: int = 3
    radius: int = 5
    gamma: float = 1.5
    clip: float = 2.0
    tiles: int = 4


def sized(image: np.ndarray, size: int, letterbox: bool) -> np.ndarray:
    """A square image: shrunk by area, enlarged by smooth interpolation; letterboxed images keep their shape on black."""
    h, w = image.shape
    if not letterbox:
        return resized(image, size, size)
    scale = size / max(h, w)
    inner = resized(image, max(1, round(h * scale)), max(1, round(w * scale)))
    out = np.zeros((size, size), np.uint8)
    y, x = ((size - n) // 2 for n in inner.shape)
    out[y : y + inner.shape[0], x : x + inner.shape[1]] = inner
    return out


@functools.lru_cache(64)
def cubic_weights(n: int, m: int, a: float = -0.75) -> np.ndarray:
    """m x n matrix of cubic interpolation with borders repeated."""
    at = (np.arange(m) + 0.5) * n / m - 0.5
    base = np.floor(at).astype(int)
    out = np.zeros((m, n))
    for k in range(-1, 3):
        d = np.abs(at - (base + k))
        wt = np.where(d <= 1, (a + 2) * d**3 - (a + 3) * d**2 + 1, np.where(d < 2, a * (d**3 - 5 * d**2 + 8 * d - 4), 0))
        np.add.at(out, (np.arange(m), np.clip(base + k, 0, n - 1)), wt)
    return out


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    h, w = image.shape
    if (h, w) == (height, width):
        return image
    weights = packed.area_weights if height <= h and width <= w else cubic_weights
    return np.floor(np.round(weights(h, height) @ image.astype(float) @ weights(w, width).T, 6) + 0.5).clip(0, 255).astype(np.uint8)


def prepared(image: np.ndarray, cfg: Preparation = Preparation()) -> np.ndarray:
    """Size, glare, gamma (brighter for more than 1), equalisation by tiles, in this order."""
    out = sized(image, cfg.size, cfg.letterbox)
    if cfg.glare:
        out = without_glare(out, cfg.threshold, cfg.grow, cfg.radius)
    curve = np.floor(np.round((np.arange(256) / 255) ** (1 / cfg.gamma) * 255, 9)).astype(np.uint8)
    return packed.clahe(curve[out], cfg.clip, cfg.tiles)
