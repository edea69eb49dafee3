import numpy as np
import pytest

from gazeflow.operators import kernel


def rows(n=500, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    return x, (x**2).sum(1) + rng.normal(0, 0.4, n) > 3.5


@pytest.mark.parametrize("c", [0.1, 1.0, 10.0])
def test_dual_is_solved(c):
    """The gap between the primal and the dual value vanishes, and a plain solver gets no further."""
    x, good = rows()
    y, k = np.where(good, 1.0, -1.0), kernel.radial(x, x, 0.25)
    a, bias = kernel.dual(k, y, c, 1e-6)
    assert (a >= 0).all() and (a <= c).all() and abs(y @ a) < 1e-8
    score = k @ (a * y) + bias
    norm = (a * y) @ k @ (a * y)
    primal, dual = norm / 2 + c * np.maximum(0, 1 - y * score).sum(), a.sum() - norm / 2
    assert 0 <= primal - dual + 1e-6 < 1e-3 * max(1, dual)
    # projected gradient steps on the dual with the bias eliminated, from another start
    q, b = k * np.outer(y, y), np.full(len(y), c / 2)
    step = 1 / np.linalg.norm(q, 2)
    for _ in range(800):
        b += (1 - q @ b) * step
        low, high = -1e3, 1e3
        for _ in range(50):
            m = (low + high) / 2
            low, high = (m, high) if y @ np.clip(b - m * y, 0, c) > 0 else (low, m)
        b = np.clip(b - low * y, 0, c)
    assert dual >= b.sum() - b @ q @ b / 2 - 1e-3


def test_machine():
    x, good = rows(400)
    more, truth = rows(300, 1)
    m = kernel.fit(x, good)
    p = m.probabilities(more)
    assert ((p > 0.5) == truth).mean() > 0.85 and ((m.scores(more) > 0) == truth).mean() > 0.85
    assert np.abs(kernel.loaded(m.dumped()).probabilities(more) - p).max() == 0
    for q in (0.2, 0.8):  # calibrated: about as many are good as the curve says
        near = abs(p - q) < 0.2
        assert abs(truth[near].mean() - p[near].mean()) < 0.15
    for bad in (np.ones(400, bool), np.zeros(400, bool)):
        with pytest.raises(ValueError):
            kernel.fit(x, bad)
    flat = kernel.fit(np.zeros((20, 3)), np.arange(20) % 2 == 0)
    assert np.isfinite(flat.probabilities(np.zeros((2, 3)))).all()
