"""Machines with a radial kernel: the exact dual of a support vector machine on rows in memory, and predictors that need numpy alone."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

import numpy as np

#: Rows at most that the dual is solved for: the kernel of so many takes 128 MB.
ROWS = 4000


def radial(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    far = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(far, 0))


def dual(kernel: np.ndarray, y: np.ndarray, c: float, tolerance: float = 1e-4, steps: int = 1_000_000) -> tuple[np.ndarray, float]:
    """Weights and bias of the soft-margin dual: max sum(a) - a'Qa / 2, 0 <= a <= c, y'a = 0, for labels of 1 and -1.

    Each step moves the two weights that violate the conditions of the optimum most, until none does by ``tolerance``.
    """
    a, slope = np.zeros(len(y)), -np.ones(len(y))  # slope: of a'Qa / 2 - sum(a)
    for _ in range(steps):
        gain = -y * slope
        up, down = np.where(y > 0, a < c, a > 0), np.where(y > 0, a > 0, a < c)
        i, j = int(np.where(up, gain, -np.inf).argmax()), int(np.where(down, gain, np.inf).argmin())
        if not up.any() or not down.any() or gain[i] - gain[j] < tolerance:
            break
        bend = max(kernel[i, i] + kernel[j, j] - 2 * kernel[i, j], 1e-12)
        room_i = c - a[i] if y[i] > 0 else a[i]
        room_j = a[j] if y[j] > 0 else c - a[j]
        t = min((gain[i] - gain[j]) / bend, room_i, room_j)
        a[i] += y[i] * t
        a[j] -= y[j] * t
        for k in (i, j):  # what is within rounding of a bound is on it
            a[k] = 0.0 if a[k] < 1e-12 * c else c if a[k] > c * (1 - 1e-12) else a[k]
        slope += t * y * (kernel[i] - kernel[j])
    gain = -y * slope
    free = (a > 0) & (a < c)
    if free.any():
        return a, float(gain[free].mean())
    up, down = np.where(y > 0, a < c, a > 0), np.where(y > 0, a > 0, a < c)
    return a, float((gain[up].max(initial=gain.min()) + gain[down].min(initial=gain.max())) / 2)


def bends(score: np.ndarray, target: np.ndarray, s: float, t: float) -> np.ndarray:
    """Sums over rows: the log loss's first (2) and second (3) derivatives by the curve's slope and shift."""
    p = 1 / (1 + np.exp(-np.clip(s * score + t, -35, 35)))
    w = p * (1 - p)
    return np.array([((p - target) * score).sum(), (p - target).sum(), (w * score * score).sum(), (w * score).sum(), w.sum()])


def targets(good: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Smoothed shares of good rows, by the numbers of good rows and others."""
    return np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))


def newton(sums: np.ndarray) -> np.ndarray:
    """The step of slope and shift by what ``bends`` sums up over all rows."""
    g1, g2, h11, h12, h22 = sums
    return np.linalg.solve(np.array([[h11, h12], [h12, h22]]) + 1e-10 * np.eye(2), np.array([g1, g2]))


def platt(score: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from scores to shares of good rows, by Newton steps on smoothed targets."""
    target = targets(good, good.sum(), (~good).sum())
    s, t = 1.0, 0.0
    for _ in range(100):
        move = newton(bends(score, target, s, t))
        s, t = s - move[0], t - move[1]
        if np.abs(move).max() < 1e-9:
            break
    return float(s), float(t)


class Predictor:
    """What machines of either kind share: probabilities of scores, and their text."""

    slope: float
    shift: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.scores(x) + self.shift, -35, 35)))

    def dumped(self) -> str:
        arrays = {k: {"shape": v.shape, "data": base64.b64encode(v.astype("<f8").tobytes()).decode()} for k, v in vars(self).items() if isinstance(v, np.ndarray)}
        return json.dumps(arrays | {k: v for k, v in vars(self).items() if not isinstance(v, np.ndarray)})


@dataclass(frozen=True)
class Machine(Predictor):
    """A fitted machine: scaling, support rows with their signed weights, bias, gamma, and the curve to probabilities."""

    centre: np.ndarray
    scale: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    bias: float
    gamma: float
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        return radial((x - self.centre) / self.scale, self.rows, self.gamma) @ self.weights + self.bias


@dataclass(frozen=True)
class Waves(Predictor):
    """A fitted machine on random Fourier features of the radial kernel: its size does not depend on the rows it was fitted on."""

    centre: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.cos((x - self.centre) / self.scale @ self.waves + self.phases) @ self.weights + self.bias


def loaded(text: str) -> Machine | Waves:
    raw = json.loads(text)
    kind = Waves if "waves" in raw else Machine
    return kind(**{k: np.frombuffer(base64.b64decode(v["data"]), "<f8").reshape(v["shape"]) if isinstance(v, dict) else v for k, v in raw.items()})


def fit(x: np.ndarray, good: np.ndarray, c: float = 10.0, gamma: float | None = None, folds: int = 5) -> Machine:
    """Scale by the rows' own mean and population deviation, solve the dual, and fit the curve on scores of rows left out in turn.

    ``gamma`` is 1 / (columns x variance) of the scaled rows unless given. Rows of one class alone, or too many, are an error.
    """
    good = np.asarray(good, bool)
    if len(x) > ROWS or good.all() or not good.any():
        raise ValueError(f"a machine needs rows of both classes, {ROWS} at most")
    centre, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 0, scale, 1.0)
    z, y = (x - centre) / scale, np.where(good, 1.0, -1.0)
    gamma = gamma or 1 / (z.shape[1] * max(float(z.var()), 1e-12))
    kernel = radial(z, z, gamma)
    a, bias = dual(kernel, y, c)
    fold, out = np.arange(len(x)) % folds, np.zeros(len(x))
    for k in range(folds):
        rest, own = fold != k, fold == k
        if own.any() and good[rest].any() and not good[rest].all():
            b, d = dual(kernel[np.ix_(rest, rest)], y[rest], c)
            out[own] = kernel[np.ix_(own, rest)] @ (b * y[rest]) + d
    slope, shift = platt(out, good)
    held = a > 0
    return Machine(centre, scale, z[held], (a * y)[held], bias, gamma, slope, shift)
