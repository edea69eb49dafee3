"""Connected components and erosion depths of packed masks, all masks of an Arrow batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def stacked(column: pa.Array, h: int, w: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), h, w)


def shifted(x: np.ndarray, dy: int, dx: int, fill: int) -> np.ndarray:
    """x[:, y + dy, x + dx], ``fill`` outside."""
    out = np.full_like(x, fill)
    h, w = x.shape[1:]
    out[:, max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = x[:, max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes is linked with by edges (a, b): labels spread along edges and jump along labels."""
    label = np.arange(n)
    while True:
        new, low = label.copy(), np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(masks: np.ndarray, eight: bool) -> np.ndarray:
    """Each foreground pixel's smallest position in its component, -1 for background.

    The runs of pixels in the rows of all masks are nodes, and runs that touch in rows that follow one another are linked.
    """
    n, h, w = masks.shape
    fore = masks > 0
    step = np.diff(np.pad(fore, ((0, 0), (0, 0), (1, 1))).astype(np.int8), axis=2)
    image, y, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[2]
    row, wide, reach = image * h + y, w + 2, int(eight)
    # the runs of the next row that end behind where a run begins and begin before it ends
    low = np.searchsorted(row * wide + end, (row + 1) * wide + start - reach, "right")
    high = np.searchsorted(row * wide + start, (row + 1) * wide + end + reach, "left")
    near = np.where(y < h - 1, high - low, 0)
    a = np.repeat(np.arange(len(row)), near)
    b = np.arange(len(a)) - np.repeat(near.cumsum() - near, near) + np.repeat(low, near)
    out = np.full(masks.shape, -1)
    out[fore] = np.repeat((y * w + start)[linked(len(row), a, b)], end - start)
    return out


def depths(masks: np.ndarray, cross: bool) -> np.ndarray:
    """The number of erosions that each foreground pixel survives, plus one; -1 for those that no erosion removes. What lies outside does not erode."""
    left, out, k = masks > 0, np.where(masks > 0, -1, 0), 0
    near = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and not (cross and dy and dx)]
    while True:
        k += 1
        new = left.copy()
        for dy, dx in near:
            new &= shifted(left.astype(np.int64), dy, dx, 1) > 0
        gone = left & ~new
        if not gone.any():
            return out
        out[gone] = k
        left = new


def with_labels(df: DataFrame, h: int = 8, w: int = 8, eight: bool = True) -> DataFrame:
    """(img, labels, depths) of masks (img, mask): components and erosion depths by a square."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                m = stacked(batch.column(1), h, w)
                offsets = pa.array(np.arange(len(m) + 1) * h * w, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel().astype(np.int32))) for x in (components(m, eight), depths(m, False))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["img", "labels", "depths"])

    return df.select("img", "mask").mapInArrow(run, "img long, labels array<int>, depths array<int>")


def curves(df: DataFrame, steps: int, h: int = 8, w: int = 8, dilate: bool = False) -> DataFrame:
    """(img, k, n): foreground pixels of masks (img, mask) after k = 0 to ``steps`` erosions, or dilations, by a cross."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                m = stacked(batch.column(1), h, w)
                depth = depths(1 - m if dilate else m, True).reshape(len(m), -1)
                # a pixel is still there after k erosions if no erosion removes it or a later one does
                n = np.stack([((depth < 0) | (depth > k)).sum(1) for k in range(steps + 1)], axis=1)
                if dilate:
                    n = h * w - n
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), steps + 1)), pa.array(np.tile(np.arange(steps + 1, dtype=np.int32), len(m))), pa.array(n.ravel())], names=["img", "k", "n"])

    return df.select("img", "mask").mapInArrow(run, "img long, k int, n long")
