"""Transform features of stacks of images: Fourier power by radius, cosine energy, blur, and circles by a Hough transform."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np

from . import filters


def power(stack: np.ndarray) -> np.ndarray:
    """Power of the Fourier transform, zero frequency in the middle."""
    return np.fft.fftshift(np.abs(np.fft.fft2(stack.astype(float))) ** 2, axes=(1, 2))


@functools.lru_cache(16)
def distances(h: int, w: int) -> np.ndarray:
    y, x = np.mgrid[:h, :w]
    return np.sqrt(((y - h // 2) ** 2 + (x - w // 2) ** 2).astype(float))


def high_share(p: np.ndarray, radius: float = 8) -> np.ndarray:
    """Share of the power outside of a disc; 0 without any."""
    # in the order of one image's values, so that an image has the same share in any stack
    total, outside = p.sum((1, 2)), np.ascontiguousarray(p[:, distances(*p.shape[1:]) > radius]).sum(1)
    return np.where(total > 0, outside / np.where(total > 0, total, 1), 0.0)


def radial_profile(p: np.ndarray, bins: int = 8) -> np.ndarray:
    """Mean power in rings of equal width up to half the diagonal; the last one is open."""
    h, w = p.shape[1:]
    step = math.sqrt((h / 2) ** 2 + (w / 2) ** 2) / bins
    ring = sum((distances(h, w) >= i * step).astype(int) for i in range(1, bins))
    count = np.bincount(ring.ravel(), minlength=bins)
    total = np.stack([np.bincount(ring.ravel(), one.ravel(), bins) for one in p]) if len(p) else np.zeros((0, bins))
    return total / np.maximum(count, 1)


@functools.cache
def cosine(n: int) -> np.ndarray:
    u, x = np.mgrid[:n, :n]
    return np.sqrt(np.where(u == 0, 1, 2) / n) * np.cos(np.pi * (2 * x + 1) * u / (2 * n))


def compaction(stack: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """Share of the cosine transform's energy in its lowest k x k coefficients, for each k; 0 without any energy."""
    e = (cosine(stack.shape[1]) @ stack.astype(float) @ cosine(stack.shape[2]).T) ** 2
    total = e.sum((1, 2))
    return np.stack([np.where(total > 0, e[:, :k, :k].sum((1, 2)) / np.where(total > 0, total, 1), 0.0) for k in sizes], axis=1)


@dataclass(frozen=True)
class CircleSearch:
    """Edge threshold, least votes of a centre and least edge pixels on a circle, radii, distance between circles, blur."""

    high: int = 100
    votes: int = 12
    low_radius: int = 6
    top_radius: int = 14
    apart: float = 64
    blur: int = 5


def votes(stack: np.ndarray, cfg: CircleSearch = CircleSearch()) -> tuple[np.ndarray, np.ndarray]:
    """Votes for the centre of a circle at each pixel, and the edges that cast them.

    An edge pixel votes for the places at each radius along its gradient, on both sides.
    """
    n, h, w = stack.shape
    edge, gx, gy = filters.edges(filters.median(stack, cfg.blur) if cfg.blur > 1 else stack, cfg.high, cfg.high // 2)
    i, y, x = np.nonzero(edge)
    dx, dy = gx[i, y, x].astype(float), gy[i, y, x].astype(float)
    size = np.sqrt(dx * dx + dy * dy)
    total = np.zeros(n * h * w, np.int64)
    for r in range(cfg.low_radius, cfg.top_radius + 1):
        for side in (-r, r):
            cx, cy = (np.floor(np.round(at + side * d / size, 9) + 0.5).astype(np.int64) for at, d in ((x, dx), (y, dy)))
            inside = (cx >= 0) & (cx < w) & (cy >= 0) & (cy < h)
            total += np.bincount((i * h * w + cy * w + cx)[inside], minlength=n * h * w)
    return total.reshape(n, h, w), edge


def circles(stack: np.ndarray, cfg: CircleSearch = CircleSearch()) -> list[list[tuple[int, int, int, int]]]:
    """(cx, cy, radius, votes) of each image's circles, those with most votes first (of equal ones the upper, then left one).

    A centre has more votes than its left and upper neighbours and no fewer than the right and lower ones. Its radius is the
    one with most edge pixels for its length. A centre near one that was taken before is left out.
    """
    total, edge = votes(stack, cfg)
    n, h, w = total.shape
    p = np.pad(total, ((0, 0), (1, 1), (1, 1)), constant_values=-1)
    top = (total >= cfg.votes) & (total > p[:, 1:-1, :-2]) & (total > p[:, :-2, 1:-1]) & (total >= p[:, 1:-1, 2:]) & (total >= p[:, 2:, 1:-1])
    radii, out = np.arange(cfg.low_radius, cfg.top_radius + 1), []
    for k in range(n):
        ey, ex = np.nonzero(edge[k])
        cy, cx = np.nonzero(top[k])
        order = np.lexsort((cx, cy, -total[k, cy, cx]))
        taken: list[tuple[int, int, int, int]] = []
        for y, x in zip(cy[order].tolist(), cx[order].tolist(), strict=True):
            if any((x - a) ** 2 + (y - b) ** 2 < cfg.apart**2 for a, b, *_ in taken):
                continue
            far = np.floor(np.sqrt(((ey - y) ** 2 + (ex - x) ** 2).astype(float)) + 0.5).astype(int)
            on = np.bincount(far, minlength=cfg.top_radius + 1)[radii[0] : radii[-1] + 1]
            best = int(np.round(on / radii, 9).argmax())
            if on[best] >= cfg.votes:
                taken.append((x, y, int(radii[best]), int(total[k, y, x])))
        out.append(taken)
    return out


COMPACTION = (2, 4, 8, 16)
#: The 19 columns of a feature row.
COLUMNS = ["dft_high_freq_ratio", *(f"dft_radial_bin{i}" for i in range(8)), *(f"dct_compaction_k{k}" for k in COMPACTION), "laplacian_variance", "hough_found", "hough_cx", "hough_cy", "hough_radius", "hough_n_circles"]
SCHEMA = ", ".join(f"{c} {'int' if c in ('hough_found', 'hough_n_circles') else 'double'}" for c in COLUMNS)


def feature_rows(stack: np.ndarray, cfg: CircleSearch = CircleSearch()) -> dict[str, np.ndarray]:
    p = power(stack)
    found = circles(stack, cfg)
    best = np.array([c[0][:3] if c else (0, 0, 0) for c in found], float).reshape(-1, 3)
    cols = [high_share(p), *radial_profile(p).T, *compaction(stack, COMPACTION).T, filters.laplacian_variance(stack), np.array([bool(c) for c in found], np.int32), *best.T, np.array([len(c) for c in found], np.int32)]
    return dict(zip(COLUMNS, cols, strict=True))
