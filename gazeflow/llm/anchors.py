"""Content-defined stretches of texts: equal windows of bytes fall into equal stretches wherever they stand."""

from __future__ import annotations

import numpy as np

U = np.uint64
TOP = U(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a one-to-one scrambling of its input."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of x[i : i + width] for each i; what lies beyond the end doesn't count."""
    f, fill = (np.minimum, TOP) if least else (np.maximum, U(0))
    n = len(x)
    rows = -(-n // width) + 1
    padded = np.full(rows * width, fill, U)
    padded[:n] = x
    grid = padded.reshape(rows, width)
    before = f.accumulate(grid, axis=1).ravel()
    after = f.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(after[:n], before[width - 1 : n + width - 1])


class Rolling:
    """Hashes of byte ranges from prefix sums of an odd base's powers."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.letter = rng.integers(0, 1 << 63, 256, dtype=U) * U(2) + rng.integers(0, 2, 256, dtype=U)
        self.base = int(rng.integers(1 << 40, 1 << 62)) * 2 + 1
        self.power, self.back = np.ones(1, U), np.ones(1, U)

    def sums(self, data: np.ndarray) -> np.ndarray:
        while len(self.power) <= len(data):
            k = len(self.power)
            self.power = np.concatenate([self.power, self.power * U(pow(self.base, k, 1 << 64))])
            self.back = np.concatenate([self.back, self.back * U(pow(self.base, -k, 1 << 64))])
        out = np.zeros(len(data) + 1, U)
        np.cumsum(self.letter[data] * self.power[: len(data)], out=out[1:])
        return out

    def range(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.back[start] + (end - start).astype(U))


class Stretches:
    """Cuts texts into overlapping stretches so that every window of ``window`` bytes lies in one, and equal windows lie alike in stretches of one class.

    A stretch surrounds an anchor: the place whose hash of ``gram`` bytes is the least within some window. Its class is that
    hash; it reaches from ``window - gram`` bytes before the anchor to ``window`` after it, as far as the text does.
    """

    def __init__(self, window: int):
        self.window, self.gram = window, max(1, window // 2)
        self.reach = window - self.gram
        self.one, self.two = Rolling(3), Rolling(5)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """For each stretch, by text and place: text, start, anchor, end (in the text), class and a hash of its bytes and the anchor's place in them."""
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        n, ends = len(data), np.cumsum(sizes)
        if n < self.window:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U, U))
        sums = self.one.sums(data)
        last = n - self.gram + 1
        gram = mix((sums[self.gram :] - sums[:last]) * self.one.back[:last]) | U(1)  # never 0
        # no gram and no window crosses the border of two texts
        left = np.repeat(ends, sizes) - np.arange(n)
        gram[left[:last] < self.gram] = TOP
        lowest = sliding(gram, self.reach + 1, True)
        lowest[left[:last] < self.window] = 0
        highest = sliding(lowest[::-1], self.reach + 1, False)[::-1]
        anchor = np.flatnonzero(highest == gram)
        of = np.searchsorted(ends, anchor, "right")
        first = ends[of] - sizes[of]
        start, end = np.maximum(anchor - self.reach, first), np.minimum(anchor + self.window, ends[of])
        own = self.two.range(self.two.sums(data), start, end) + mix((anchor - start).astype(U))
        return of, start - first, anchor - first, end - first, gram[anchor], own
