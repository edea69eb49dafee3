"""Likeness of two stacks of images (n x h x w), one value for each pair."""

from __future__ import annotations

import numpy as np


def mse(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a.astype(np.int64) - b
    return (d * d).mean((1, 2))


def psnr(error: np.ndarray) -> np.ndarray:
    """Decibels by mean squared errors; infinite for none."""
    with np.errstate(divide="ignore"):
        return 10 * np.log10(65025 / error)


def box_sums(a: np.ndarray, k: int) -> np.ndarray:
    """Sums of all k x k windows that lie within the images."""
    s = np.pad(a, ((0, 0), (1, 0), (1, 0))).cumsum(1).cumsum(2)
    return s[:, k:, k:] - s[:, :-k, k:] - s[:, k:, :-k] + s[:, :-k, :-k]


def ssim(a: np.ndarray, b: np.ndarray, k: int = 7) -> np.ndarray:
    """Mean structural similarity of uniform k x k windows that lie within the images, with sample covariances."""
    x, y, n = a.astype(np.int64), b.astype(np.int64), k * k
    mx, my = box_sums(x, k) / n, box_sums(y, k) / n
    vx, vy, cov = ((box_sums(p, k) / n - q) * n / (n - 1) for p, q in ((x * x, mx * mx), (y * y, my * my), (x * y, mx * my)))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return ((2 * mx * my + c1) * (2 * cov + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean((1, 2))
