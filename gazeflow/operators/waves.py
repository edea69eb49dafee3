"""Kernel machines fitted on all rows of a table, of any number: least squares on random Fourier features, by sums over the rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, in_arrow, stored
from . import kernel

#: Fourier features of a machine: their inner products are the kernel's values but for about one in the square root of so many.
WAVES = 512


@dataclass(frozen=True)
class Space:
    """Fourier features of sets of columns. A set joins ranges of columns, which are projected once for all sets."""

    centre: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    ranges: tuple[tuple[int, int], ...]
    sets: tuple[tuple[int, ...], ...]
    widths: tuple[float, ...]

    def features(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Of each set in turn, and a last column of ones."""
        z = (x - self.centre) / self.scale
        own = [z[:, a:b] @ self.waves[a:b] for a, b in self.ranges]
        for chosen, width in zip(self.sets, self.widths, strict=True):
            f = np.cos(width * sum(own[i] for i in chosen) + self.phases) * np.sqrt(2 / len(self.phases))
            yield np.concatenate([f, np.ones((len(f), 1))], axis=1)


@dataclass(frozen=True)
class Fit:
    """Weights of each set's features (the last one is the bias), and slopes and shifts of the curves to probabilities."""

    space: Space
    weights: np.ndarray
    curves: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """A column for each set."""
        s = np.stack([f @ w for f, w in zip(self.space.features(x), self.weights, strict=True)], 1)
        return 1 / (1 + np.exp(-np.clip(s * self.curves[:, 0] + self.curves[:, 1], -35, 35)))

    def machine(self, k: int = 0) -> kernel.Waves:
        p = self.space
        at = np.concatenate([np.arange(*p.ranges[i]) for i in p.sets[k]])
        return kernel.Waves(p.centre[at], p.scale[at], p.waves[at] * p.widths[k], p.phases, self.weights[k, :-1] * np.sqrt(2 / len(p.phases)), float(self.weights[k, -1]), *map(float, self.curves[k]))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column without nulls, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sums(rows: DataFrame, part) -> list[tuple[np.ndarray, ...]]:
    """What ``part`` makes of the batches of each task, a tuple of arrays, in the order of the tasks; nothing of a task without rows."""

    def run(batches):
        found = part(b for b in batches if b.num_rows)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[np.asarray(v, float).tobytes() for v in found]], pa.list_(pa.binary()))], names=["v"])

    return [tuple(np.frombuffer(v) for v in r.v) for r in in_arrow(rows, run, "v array<binary>").collect()]


def moments(rows: DataFrame) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """How many rows (good, x) there are and how many are good; each column's mean and population deviation, 0 if it has one value alone."""

    def joined(one, two):
        (n, good, mean, m2, low, high), (n_, good_, mean_, m2_, low_, high_) = one, two
        all_, gap = n + n_, mean_ - mean
        return all_, good + good_, mean + gap * (n_ / all_), m2 + m2_ + gap * gap * (n * n_ / all_), np.minimum(low, low_), np.maximum(high, high_)

    def part(batches):
        out = None
        for batch in batches:
            x = matrix(batch.column(1))
            mean = x.mean(0)
            one = np.array([len(x)]), batch.column(0).to_numpy(zero_copy_only=False).sum(keepdims=True), mean, ((x - mean) ** 2).sum(0), x.min(0), x.max(0)
            out = one if out is None else joined(out, one)
        return out

    found = sums(rows, part)
    if not found:
        return 0, 0, np.zeros(0), np.zeros(0)
    out = found[0]
    for one in found[1:]:
        out = joined(out, one)
    n, good, mean, m2, low, high = out
    return int(n[0]), int(good[0]), np.where(low == high, low, mean), np.where(low == high, 0.0, np.sqrt(m2 / n))


def products(rows: DataFrame, space: Space, folds: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Of each set and fold of rows (good, x, fold): the products of all pairs of features, and of the features and labels of 1 and -1, summed up.

    A task sends upper halves of its sums, which are added up before the driver gets them.
    """
    sc, n = rows.sparkSession.sparkContext, len(space.phases) + 1
    shared, upper, schema = sc.broadcast(space), np.triu_indices(n), "k int, v binary"

    def run(batches):
        total: dict = {}
        for batch in batches:
            if batch.num_rows:
                y, fold = np.where(batch.column(0).to_numpy(zero_copy_only=False), 1.0, -1.0), batch.column(2).to_numpy()
                for s, f in enumerate(shared.value.features(matrix(batch.column(1)))):
                    for k in np.unique(fold).tolist():
                        own = f[fold == k]
                        g, b = total.setdefault(s * folds + k, (np.zeros((n, n)), np.zeros(n)))
                        g += own.T @ own
                        b += y[fold == k] @ own
        for k, (g, b) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.concatenate([g[np.triu_indices(n)], b]).tobytes()], pa.binary())], names=["k", "v"])

    def added(batches):
        total: dict = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.frombuffer(v.as_buffer())
                total[k] = total[k] + v if k in total else v.copy()
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["k", "v"])

    # as many tasks as run at once, so that what they send does not grow with the rows
    parts = in_arrow(rows.coalesce(sc.defaultParallelism), run, schema)
    out = {}
    for k, v in in_arrow(parts.repartition(len(space.sets) * folds, "k"), added, schema).toLocalIterator():
        v = np.frombuffer(v)
        g = np.zeros((n, n))
        g[upper] = v[:-n]
        out[divmod(k, folds)] = np.triu(g) + np.triu(g, 1).T, v[-n:]
    shared.unpersist()
    return out


def fit(rows: DataFrame, key: str, label: str, ranges: tuple[tuple[int, int], ...] | None = None, sets: tuple[tuple[int, ...], ...] = ((0,),), c: float = 10.0, folds: int = 5, waves: int = WAVES, seed: int = 7) -> Fit:
    """Machines on sets of the columns of x, fitted on all rows (key, x, label) that have x and a label; they are read three times.

    Columns are scaled by the rows' own mean and population deviation, and gamma is 1 / (columns that vary), as those of the dual.
    A least-squares machine needs sums of products of features alone, so that its optimum comes from all rows in one pass, with
    those of each fold left out as well. The curve is fitted on all rows' scores by the machines that left out their folds.
    """
    rows = rows.where(F.col("x").isNotNull() & F.col(label).isNotNull()).select(F.col(label).cast("boolean").alias("good"), "x", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int").alias("fold"))
    n, n1, centre, deviation = moments(rows)
    if n1 in (0, n):
        raise ValueError("a machine needs rows of both classes")
    rng = np.random.default_rng(seed)
    ranges = ranges or ((0, len(centre)),)
    widths = tuple(float(np.sqrt(2 / max(1, sum(int((deviation[a:b] > 0).sum()) for a, b in (ranges[i] for i in chosen))))) for chosen in sets)
    space = Space(centre, np.where(deviation > 0, deviation, 1.0), rng.normal(size=(len(centre), waves)), rng.uniform(0, 2 * np.pi, waves), ranges, sets, widths)
    sent, out = products(rows, space, folds), np.zeros((len(sets), folds, waves + 1))
    ridge, weights = np.diag([*[1 / c] * waves, 0.0]), np.zeros((len(sets), waves + 1))
    for s in range(len(sets)):
        own = {k: sent.pop((s, k)) for k in range(folds) if (s, k) in sent}
        g, b = sum(v[0] for v in own.values()), sum(v[1] for v in own.values())
        weights[s] = np.linalg.solve(g + ridge, b)
        for k, (less, less_b) in own.items():
            if abs(b[-1] - less_b[-1]) < g[-1, -1] - less[-1, -1] - 0.5:  # both classes are left
                out[s, k] = np.linalg.solve(g - less + ridge, b - less_b)
    return Fit(space, weights, curves(rows, space, out, n1, n - n1))


def curves(rows: DataFrame, space: Space, held: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Slope and shift of each set's curve, from the scores of rows (good, x, fold) by the weights that were fitted without their folds."""
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast((space, held))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p, w = shared.value
                fold = batch.column(2).to_numpy()
                s = np.stack([(f * w[i, fold]).sum(1) for i, f in enumerate(p.features(matrix(batch.column(1))))], 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s.tolist(), pa.list_(pa.float64()))], names=["good", "s"])

    scores = stored(in_arrow(rows, run, "good boolean, s array<double>"), "scores")
    few, at = scores.coalesce(sc.defaultParallelism), np.tile([1.0, 0.0], (len(held), 1))
    live = np.ones(len(held), bool)
    for _ in range(100):

        def part(batches, at=at.copy()):
            out = None
            for batch in batches:
                target = kernel.targets(batch.column(0).to_numpy(zero_copy_only=False), n1, n0)
                one = np.stack([kernel.bends(s, target, *to) for s, to in zip(matrix(batch.column(1)).T, at, strict=True)]).ravel()
                out = (one,) if out is None else (out[0] + one,)
            return out

        move = np.stack([kernel.newton(v) for v in sum(v[0] for v in sums(few, part)).reshape(-1, 5)])
        at[live] -= move[live]
        live &= np.abs(move).max(1) >= 1e-9
        if not live.any():
            break
    discard(scores)
    shared.unpersist()
    return at
