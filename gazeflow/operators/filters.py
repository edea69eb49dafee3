"""Filters, gradients, thresholds and edges on stacks of images (n x h x w bytes), in whole numbers wherever results are."""

from __future__ import annotations

import math

import numpy as np


def padded(stack: np.ndarray, r: int, border: str = "mirror") -> np.ndarray:
    """Filled up by r pixels on each side: mirrored at the border pixel, or by the border pixel itself (``clamp``)."""
    return np.pad(stack, ((0, 0), (r, r), (r, r)), "reflect" if border == "mirror" and min(stack.shape[1:]) > r else "edge")


def weighted(stack: np.ndarray, rows: list[int], columns: list[int], border: str = "mirror") -> np.ndarray:
    """Sums under a kernel that is the product of a column of weights and a row of weights."""
    h, w, r = *stack.shape[1:], len(rows) // 2
    p = padded(stack.astype(np.int32), r, border)
    down = sum(k * p[:, i : i + h] for i, k in enumerate(rows) if k)
    return sum(k * down[:, :, i : i + w] for i, k in enumerate(columns) if k)


def mean(stack: np.ndarray, size: int) -> np.ndarray:
    """Mean of size x size pixels, rounded half up."""
    n = size * size
    return ((weighted(stack, [1] * size, [1] * size) * 2 + n) // (2 * n)).astype(np.uint8)


def gauss(stack: np.ndarray, size: int) -> np.ndarray:
    """Binomial weights of size x size pixels, rounded half up."""
    row = [math.comb(size - 1, i) for i in range(size)]
    n = 4 ** (size - 1)
    return ((weighted(stack, row, row) * 2 + n) // (2 * n)).astype(np.uint8)


def median(stack: np.ndarray, size: int) -> np.ndarray:
    """Median of size x size pixels, borders repeated: its bits are found from the highest on, by counts of darker pixels."""
    p, half = padded(stack, size // 2, "clamp"), size * size // 2
    h, w = stack.shape[1:]
    out = np.zeros(stack.shape, np.int32)
    for bit in (128, 64, 32, 16, 8, 4, 2, 1):
        probe = out + bit
        below = np.zeros(stack.shape, np.int16)
        for dy in range(size):
            for dx in range(size):
                below += p[:, dy : dy + h, dx : dx + w] < probe
        out = np.where(below <= half, probe, out)
    return out.astype(np.uint8)


def sobel(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Changes to the right and downwards."""
    return weighted(stack, [1, 2, 1], [-1, 0, 1]), weighted(stack, [-1, 0, 1], [1, 2, 1])


def laplacian_variance(stack: np.ndarray) -> np.ndarray:
    """Population variance of the four-neighbour Laplacian, from exact sums."""
    p, n = padded(stack.astype(np.int64), 1), stack[0].size
    v = p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:] - 4 * p[:, 1:-1, 1:-1]
    return (n * (v * v).sum((1, 2)) - v.sum((1, 2)) ** 2) / (n * n)


def histograms(stack: np.ndarray) -> np.ndarray:
    n = len(stack)
    return np.bincount((stack.reshape(n, -1) + 256 * np.arange(n)[:, None]).ravel(), minlength=256 * n).reshape(n, 256)


def otsu(stack: np.ndarray) -> np.ndarray:
    """The threshold whose two classes differ most, the first of equal ones; the only value of a constant image."""
    h = histograms(stack)
    n0, s0 = h.cumsum(1).astype(float), (h * np.arange(256)).cumsum(1).astype(float)
    n, s = n0[:, -1:], s0[:, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where((n0 > 0) & (n0 < n), np.round((s0 * n - s * n0) ** 2 / (n0 * (n - n0)), 6), -1)
    return np.where(score.max(1) < 0, stack.min((1, 2)), score.argmax(1))


def edges(stack: np.ndarray, high: int = 100, low: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Thin edges and the gradients: pixels whose gradient is highest across the edge, strong or joined to a strong one.

    The size of a gradient is the sum of its parts' absolute values; its direction is one of four, by the ratio of 2 to 5.
    """
    gx, gy = sobel(stack)
    ax, ay = np.abs(gx), np.abs(gy)
    size = ax + ay
    p, (h, w) = np.pad(size, ((0, 0), (1, 1), (1, 1))), stack.shape[1:]
    at = lambda dy, dx: p[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    flat, steep, same = ay * 5 <= ax * 2, ax * 5 <= ay * 2, gx.astype(np.int64) * gy >= 0
    before = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(same, at(-1, -1), at(-1, 1))))
    after = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(same, at(1, 1), at(1, -1))))
    weak = (size >= low) & (size > before) & (size >= after)
    found = weak & (size >= high)
    while True:
        q = np.pad(found, ((0, 0), (1, 1), (1, 1)))
        more = weak & np.logical_or.reduce([q[:, dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)])
        if (more == found).all():
            return found, gx, gy
        found = more
