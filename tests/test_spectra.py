import numpy as np
import pytest

from gazeflow.functions import grids
from gazeflow.operators import filters, spectra


def noisy(n=4, h=20, w=27, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (n, h, w), dtype=np.uint8)


def windows(image, size, border):
    p = np.pad(image, size // 2, border)
    return np.array([[p[y : y + size, x : x + size].ravel() for x in range(image.shape[1])] for y in range(image.shape[0])]).astype(int)


@pytest.mark.parametrize("size", [3, 5, 7])
def test_filters(size):
    stack = noisy()
    for out, f, border in (
        (filters.median(stack, size), lambda v: np.median(v, axis=2), "edge"),
        (filters.mean(stack, size), lambda v: np.floor(v.mean(2) + 0.5), "reflect"),
        (filters.gauss(stack, size), lambda v: np.floor((v * [k for *_, k in grids.binomial(size)]).sum(2) / 4 ** (size - 1) + 0.5), "reflect"),
    ):
        assert (out == np.stack([f(windows(image, size, border)) for image in stack])).all()


def test_otsu():
    stack = np.concatenate([noisy(3), np.full((1, 20, 27), 9, np.uint8)])
    for image, t in zip(stack, filters.otsu(stack), strict=True):
        spread = {v: (image <= v).mean() * (image > v).mean() * (image[image <= v].mean() - image[image > v].mean()) ** 2 for v in set(image.ravel().tolist()) if (image > v).any()}
        assert t == (min(spread, key=lambda v: (-round(spread[v], 9), v)) if spread else 9)


def disc(cy, cx, r, size=64, inside=40, outside=200):
    y, x = np.mgrid[:size, :size]
    return np.where((y - cy) ** 2 + (x - cx) ** 2 <= r * r, inside, outside).astype(np.uint8)


def test_circles():
    stack = np.stack([disc(30, 25, 10), disc(20, 40, 7), np.full((64, 64), 90, np.uint8), disc(32, 32, 25)])
    found = spectra.circles(stack)
    for (cx, cy, r), got in zip(((25, 30, 10), (40, 20, 7)), found):
        assert abs(got[0][0] - cx) <= 1 and abs(got[0][1] - cy) <= 1 and abs(got[0][2] - r) <= 1
    assert found[2] == [] and found[3] == []
    two = np.minimum(disc(16, 16, 8), disc(48, 46, 9))
    cfg = spectra.CircleSearch(apart=20)
    assert len(spectra.circles(two[None], cfg)[0]) == 2 and len(spectra.circles(two[None])[0]) == 1


def test_votes_of_each_edge_pixel():
    stack = noisy(2, 24, 24)
    cfg = spectra.CircleSearch(low_radius=2, top_radius=3, blur=0)
    total, edge = spectra.votes(stack, cfg)
    gx, gy = filters.sobel(stack)
    want = np.zeros_like(total)
    for i, y, x in np.argwhere(edge):
        for r in (2, 3):
            for side in (-r, r):
                size = np.hypot(gx[i, y, x], gy[i, y, x])
                cx, cy = int(np.floor(x + side * gx[i, y, x] / size + 0.5 + 1e-12)), int(np.floor(y + side * gy[i, y, x] / size + 0.5 + 1e-12))
                if 0 <= cx < 24 and 0 <= cy < 24:
                    want[i, cy, cx] += 1
    assert edge.any() and (total == want).all()


def test_feature_rows():
    stack = np.concatenate([noisy(2, 64, 64), np.zeros((1, 64, 64), np.uint8), disc(30, 30, 10)[None]])
    rows = spectra.feature_rows(stack)
    assert list(rows) == spectra.COLUMNS and len(spectra.COLUMNS) == 19
    power = np.abs(np.fft.fftshift(np.fft.fft2(stack[0]))) ** 2
    y, x = np.mgrid[:64, :64]
    r = np.hypot(y - 32, x - 32)
    assert np.isclose(rows["dft_high_freq_ratio"][0], power[r > 8].sum() / power.sum())
    step = np.hypot(32, 32) / 8
    for k in range(8):
        inside = (r >= k * step) & ((r < (k + 1) * step) | (k == 7))
        assert np.isclose(rows[f"dft_radial_bin{k}"][0], power[inside].mean())
    assert rows["dft_high_freq_ratio"][2] == rows["dct_compaction_k2"][2] == 0 and rows["dct_compaction_k16"][3] > 0.9
    assert rows["hough_found"].tolist()[2:] == [0, 1]
    lap = np.array([[(windows(stack[1], 3, "reflect")[a, b] * [0, 1, 0, 1, -4, 1, 0, 1, 0]).sum() for b in range(64)] for a in range(64)])
    assert np.isclose(rows["laplacian_variance"][1], lap.var())
