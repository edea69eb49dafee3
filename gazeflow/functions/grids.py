"""Image operators as expressions on packed gray images: arrays of height x width values, row by row.

A stencil is evaluated inside the row, so it needs no exploded pixels, join or shuffle. Borders follow the named rule.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Kernel = list[tuple[int, int, float]]

SQUARE: Kernel = [(dy, dx, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
CROSS: Kernel = [(-1, 0, 1), (0, -1, 1), (0, 0, 1), (0, 1, 1), (1, 0, 1)]
GAUSS: Kernel = [(dy, dx, (2 - abs(dy)) * (2 - abs(dx))) for dy, dx, _ in SQUARE]
SHARPEN: Kernel = [(dy, dx, 5 if (dy, dx) == (0, 0) else -1) for dy, dx, _ in CROSS]
LAPLACE4: Kernel = [(dy, dx, -4 if (dy, dx) == (0, 0) else 1) for dy, dx, _ in CROSS]
LAPLACE8: Kernel = [(-1, -1, 2), (-1, 1, 2), (0, 0, -8), (1, -1, 2), (1, 1, 2)]
SOBEL_X: Kernel = [(dy, dx, dx * (2 - abs(dy))) for dy, dx, _ in SQUARE if dx]
SOBEL_Y: Kernel = [(dy, dx, dy * (2 - abs(dx))) for dy, dx, _ in SQUARE if dy]
PREWITT_X: Kernel = [(dy, dx, dx) for dy, dx, _ in SQUARE if dx]
PREWITT_Y: Kernel = [(dy, dx, dy) for dy, dx, _ in SQUARE if dy]
ROBERTS_X: Kernel = [(0, 0, 1), (-1, -1, -1)]
ROBERTS_Y: Kernel = [(0, -1, 1), (-1, 0, -1)]


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once; a plain expression would be computed anew at each use inside a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def box(size: int) -> Kernel:
    r = size // 2
    return [(dy, dx, 1) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def binomial(size: int) -> Kernel:
    """Integer Gaussian weights: products of binomial coefficients."""
    row = [math.comb(size - 1, i) for i in range(size)]
    r = size // 2
    return [(y - r, x - r, row[y] * row[x]) for y in range(size) for x in range(size)]


def element(shape: str, size: int) -> Kernel:
    """A structuring element: ``rect``, ``cross`` or ``ellipse``."""
    r, out = size // 2, []
    for dy in range(-r, r + 1):
        reach = {"rect": r, "cross": r if dy == 0 else 0, "ellipse": round(math.sqrt(r * r - dy * dy))}[shape]
        out += [(dy, dx, 1) for dx in range(-reach, reach + 1)]
    return out


class Grid:
    """Expressions for images of one height and width."""

    def __init__(self, height: int = 8, width: int = 8):
        self.h, self.w = height, width

    def each(self, f: Callable[[Column, Column], Column]) -> Column:
        """An array with f(y, x) at each pixel."""
        return F.transform(F.sequence(F.lit(0), F.lit(self.h * self.w - 1)), lambda i: f(F.floor(i / self.w).cast("int"), (i % self.w).cast("int")))

    def at(self, image: Column, y: Column, x: Column) -> Column:
        return F.get(image, y * self.w + x)

    @staticmethod
    def mirrored(v: Column, n: int) -> Column:
        """Positions beyond a border reflect at the border pixel, which is not repeated."""
        return F.lit(n - 1) - F.abs(F.lit(n - 1) - F.abs(v))

    @staticmethod
    def clamped(v: Column, n: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), v))

    def near(self, image: Column, kernel: Kernel, y: Column, x: Column, border: str) -> list[Column]:
        """The values under a kernel. ``drop`` gives null outside of the image."""
        out = []
        for dy, dx, _ in kernel:
            r, c = y + dy, x + dx
            if border == "drop":
                inside = (r >= 0) & (r < self.h) & (c >= 0) & (c < self.w)
                out.append(F.when(inside, self.at(image, r, c)))
            else:
                rule = self.mirrored if border == "mirror" else self.clamped
                out.append(self.at(image, rule(r, self.h), rule(c, self.w)))
        return out

    def weighted(self, image: Column, kernel: Kernel, border: str = "mirror") -> Column:
        """Weighted sum under a kernel at each pixel."""

        def one(y: Column, x: Column) -> Column:
            total = F.lit(0)
            for v, (_, _, k) in zip(self.near(image, kernel, y, x, border), kernel, strict=True):
                total = total + v * F.lit(k)
            return total

        return self.each(one)

    def mean(self, image: Column, size: int = 3) -> Column:
        """Mean of size x size pixels, rounded half up."""
        n = size * size
        return F.transform(self.weighted(image, box(size)), lambda s: F.floor((s * 2 + n) / (2 * n)).cast("int"))

    def gauss(self, image: Column) -> Column:
        """Gaussian of 3 x 3 pixels, rounded half up."""
        return F.transform(self.weighted(image, GAUSS), lambda s: F.floor((s + 8) / 16).cast("int"))

    def median(self, image: Column, size: int = 3) -> Column:
        kernel = box(size)
        return self.each(lambda y, x: F.get(F.sort_array(F.array(*self.near(image, kernel, y, x, "clamp"))), F.lit(len(kernel) // 2)))

    def sharpen(self, image: Column) -> Column:
        return F.transform(self.weighted(image, SHARPEN), clipped)

    def unsharp(self, image: Column, amount: int = 1) -> Column:
        """image + amount * (image - blur), the blur already rounded."""
        return F.zip_with(image, self.gauss(image), lambda g, b: clipped(g + (g - b) * amount))

    def high_boost(self, image: Column, a: float = 1.5) -> Column:
        return F.zip_with(image, self.gauss(image), lambda g, b: clipped(F.floor(g * F.lit(float(a)) - b)))

    def gradient(self, image: Column, kx: Kernel = SOBEL_X, ky: Kernel = SOBEL_Y) -> Column:
        """Gradient magnitude."""
        return F.zip_with(self.weighted(image, kx), self.weighted(image, ky), lambda a, b: F.sqrt((a * a + b * b).cast("double")))

    def adaptive(self, image: Column, size: int = 3, c: int = 3) -> Column:
        """1 where a pixel is at most the rounded local mean less ``c``."""
        return F.zip_with(image, self.mean(image, size), lambda g, m: (g <= m - c).cast("int"))

    def under(self, image: Column, kernel: Kernel, f: Callable[[Column], Column]) -> Column:
        """f of the values under a kernel at each pixel, without those outside of the image; places are a constant, not computed for each row."""
        places = ([(y + dy) * self.w + x + dx for dy, dx, _ in kernel if 0 <= y + dy < self.h and 0 <= x + dx < self.w] for y in range(self.h) for x in range(self.w))
        table = F.expr(f"array({', '.join(f'array({str(p)[1:-1]})' for p in places)})")
        return F.transform(table, lambda near: f(F.transform(near, lambda i: F.get(image, i))))

    def erode(self, image: Column, kernel: Kernel = SQUARE) -> Column:
        return self.under(image, kernel, F.array_min)

    def dilate(self, image: Column, kernel: Kernel = SQUARE) -> Column:
        return self.under(image, kernel, F.array_max)

    def opened(self, image: Column, kernel: Kernel = SQUARE) -> Column:
        return let(self.erode(image, kernel), lambda m: self.dilate(m, kernel))

    def closed(self, image: Column, kernel: Kernel = SQUARE) -> Column:
        return let(self.dilate(image, kernel), lambda m: self.erode(m, kernel))

    def labelled(self, mask: Column, eight: bool = True) -> Column:
        """Connected components of a 0/1 mask: each pixel's label is its component's smallest position, -1 outside of the mask."""
        kernel = SQUARE if eight else CROSS
        start = self.each(lambda y, x: F.when(self.at(mask, y, x) == 1, y * self.w + x).otherwise(-1))

        def spread(labels: Column, _: Column) -> Column:
            def one(y: Column, x: Column) -> Column:
                near = F.filter(F.array(*self.near(labels, kernel, y, x, "drop")), lambda v: v >= 0)
                return F.when(self.at(labels, y, x) >= 0, F.array_min(near)).otherwise(-1)

            return self.each(one)

        # a label travels one pixel a step, and a shortest path has at most half of the pixels
        return F.aggregate(F.sequence(F.lit(1), F.lit(self.h * self.w // 2 + 1)), start, spread)

    def lbp(self, image: Column) -> Column:
        """Local binary pattern of the eight neighbours, clockwise from the upper left, borders clamped."""
        ring = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
        kernel = [(dy, dx, 1 << i) for i, (dy, dx) in enumerate(ring)]

        def one(y: Column, x: Column) -> Column:
            total = F.lit(0)
            for v, (_, _, k) in zip(self.near(image, kernel, y, x, "clamp"), kernel, strict=True):
                total = total + F.when(v >= self.at(image, y, x), k).otherwise(0)
            return total

        return self.each(one)


def clipped(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("int")


def equalized(image: Column) -> Column:
    """Histogram equalisation by the image's own cumulative counts, rounded half to even."""
    n = F.size(image)

    def spread(low: Column) -> Column:
        return F.transform(image, lambda g: F.when(n == low, g).otherwise(F.bround((F.size(F.filter(image, lambda v: v <= g)) - low) / F.greatest(n - low, F.lit(1)) * 255).cast("int")))

    return let(let(F.array_min(image), lambda m: F.size(F.filter(image, lambda v: v == m))), spread)


def otsu(image: Column) -> Column:
    """The threshold with the highest variance between classes, over the image's own values; the first of equal ones."""
    n, total = F.size(image).cast("double"), F.aggregate(image, F.lit(0), lambda a, v: a + v).cast("double")

    def split(t: Column) -> Column:
        low = F.filter(image, lambda v: v <= t)
        n0 = F.size(low).cast("double")
        s0 = F.aggregate(low, F.lit(0), lambda a, v: a + v).cast("double")
        between = F.when((n0 > 0) & (n0 < n), F.pow(s0 * n - total * n0, F.lit(2)) / (n0 * (n - n0))).otherwise(F.lit(-1.0))
        return F.struct(F.round(between, 6).alias("v"), (-t).alias("t"))

    return -F.array_max(F.transform(F.array_distinct(image), split))["t"]


def image_mean(image: Column) -> Column:
    return F.aggregate(image, F.lit(0), lambda a, v: a + v) / F.size(image)


def squared_error(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0), lambda s, v: s + v) / F.size(a)


def psnr(mse: Column) -> Column:
    """Infinity for equal images."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(F.log10(F.lit(65025.0) / mse) * 10)
