"""From an eye image to its features and to open or closed: one function for a single image, a table and a stream."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grids import element
from ..session import in_arrow, stored
from . import filters, frames, inpaint, jpeg, kernel, packed, regions, spectra, waves

FAMILIES = ("morph", "transform", "hog", "lbp")
#: Files that are decoded at once if they have so few bytes each, and images whose features are made at once.
FILES, SMALL, IMAGES = 256, 4096, 64
#: Machines by their text, loaded once in each worker.
_LOADED: dict[str, kernel.Machine | kernel.Waves] = {}


def dark_regions(stack: np.ndarray, share: float = 0.7) -> np.ndarray:
    """The cleaned masks of what is darker than a share of Otsu's threshold."""
    masks = (stack < (filters.otsu(stack) * share)[:, None, None]).astype(np.int64)
    return regions.opened_closed(masks, element("ellipse", 3), element("ellipse", 5))


def vectors_of(images: list[np.ndarray], families: tuple[str, ...] = FAMILIES, cfg: inpaint.Preparation = inpaint.Preparation()) -> np.ndarray:
    """Features of gray images of any size, by families in their order; what is not finite becomes 0, or a million of its sign.

    A row of each image, the same in whatever stack it stands.
    """
    ready = np.stack([inpaint.prepared(image, cfg) for image in images])
    parts = []
    for family in families:
        if family == "morph":
            found = regions.shape_rows(dark_regions(ready), outline=False)
            parts.append(np.stack([found[c] for c in regions.SHAPE], 1))
        elif family == "transform":
            found = spectra.feature_rows(ready)
            parts.append(np.stack([found[c].astype(float) for c in spectra.COLUMNS], 1))
        elif family == "hog":
            parts.append(np.stack([packed.hog(image) for image in ready]).astype(float))
        elif family == "lbp":
            parts.append(np.stack([packed.lbp_histogram(image) for image in ready]))
        else:
            raise ValueError(f"no family {family!r}")
    return np.nan_to_num(np.concatenate(parts, 1), nan=0.0, posinf=1e6, neginf=-1e6)


def vector(image: np.ndarray, families: tuple[str, ...] = FAMILIES, cfg: inpaint.Preparation = inpaint.Preparation()) -> np.ndarray:
    return vectors_of([image], families, cfg)[0]


def decoded(files: list[bytes]) -> list[np.ndarray | ValueError]:
    """The images of gray JPEG files, all at once, and of 8-bit gray PNG files (not interlaced); an error in place of anything else."""
    png = [i for i, data in enumerate(files) if data[:8] == b"\x89PNG\r\n\x1a\n"]
    rest = sorted(set(range(len(files))) - set(png))
    out: list = [None] * len(files)
    for i, image in zip(rest, jpeg.decode([files[i] for i in rest]), strict=True):
        out[i] = image
    for i in png:
        try:
            out[i] = png_image(files[i])
        except ValueError as e:
            out[i] = e
    return out


def png_image(data: bytes) -> np.ndarray:
    try:
        at, body, size = 8, b"", None
        while at < len(data):
            n, kind = struct.unpack_from(">I4s", data, at)
            part = data[at + 8 : at + 8 + n]
            size, body, at = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else size, body + part if kind == b"IDAT" else body, at + n + 12
        w, h, *kind = size
        if kind != [8, 0, 0, 0, 0]:
            raise ValueError("only gray PNG files of 8 bits are read")
        rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w + 1)
    except (struct.error, zlib.error, TypeError) as e:
        raise ValueError(f"a damaged PNG file: {e}") from e
    out = np.zeros((h + 1, w + 1), np.int64)  # a row above and a column before, of zeros
    for y, row in enumerate(rows.tolist(), 1):
        line, above = out[y], out[y - 1]
        if row[0] == 0:
            line[1:] = row[1:]
        elif row[0] == 1:
            line[1:] = np.cumsum(row[1:]) & 255
        elif row[0] == 2:
            line[1:] = (above[1:] + row[1:]) & 255
        else:
            for x, v in enumerate(row[1:], 1):
                a, b, c = int(line[x - 1]), int(above[x]), int(above[x - 1])
                if row[0] == 3:
                    v += (a + b) // 2
                else:
                    v += min(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))[2]
                line[x] = v & 255
    return out[1:, 1:].astype(np.uint8)


def featured(files: list[bytes | None], families: tuple[str, ...] = FAMILIES) -> list[np.ndarray | ValueError]:
    """The features of image files; an error in place of those of a file that can't be read."""
    out: list = decoded([data or b"" for data in files])
    good = [i for i, image in enumerate(out) if not isinstance(image, ValueError)]
    for some in (good[i : i + IMAGES] for i in range(0, len(good), IMAGES)):
        for i, x in zip(some, vectors_of([out[i] for i in some], families), strict=True):
            out[i] = x
    return out


def places(families: tuple[str, ...] = FAMILIES) -> tuple[tuple[int, int], ...]:
    """Where each family's features begin and end in a vector of all of them."""
    ends = np.cumsum([0, *(len(vector(np.zeros((64, 64), np.uint8), (f,))) for f in families)]).tolist()
    return tuple(zip(ends, ends[1:]))


def parts(batches: Iterator[pa.RecordBatch], content: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into as many rows as are handled at once, by the bytes of the files in a column."""
    for batch in batches:
        yield from frames.parts([batch], FILES if batch.column(content).nbytes <= SMALL * batch.num_rows else frames.ROWS)


def machine_of(text: str) -> kernel.Machine | kernel.Waves:
    """A machine by its text, loaded once in a process."""
    if text not in _LOADED:
        _LOADED.clear()
        _LOADED[text] = kernel.loaded(text)
    return _LOADED[text]


def predict(data: bytes, machine: str, families: tuple[str, ...] = FAMILIES) -> tuple[bool, float]:
    """Whether an image file shows an open eye, and how probable that is, by a machine's text; a file that can't be read is a ValueError."""
    x = featured([data], families)[0]
    if isinstance(x, ValueError):
        raise x
    p = float(machine_of(machine).probabilities(x[None])[0])
    return p >= 0.5, p


def vectors(files: DataFrame, keys: tuple[str, ...], families: tuple[str, ...] = FAMILIES, content: str = "content") -> DataFrame:
    """(keys, x, error): features of image files, and why a file has none. Works on tables and streams."""
    schema = ", ".join(f"{k} {dict(files.dtypes)[k]}" for k in keys) + ", x array<double>, error string"

    def run(batches):
        for batch in parts(batches, len(keys)):
            found = featured(batch.column(len(keys)).to_pylist(), families)
            errors = [str(x)[:200] if isinstance(x, ValueError) else None for x in found]
            xs = [None if isinstance(x, ValueError) else x.tolist() for x in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), pa.array(xs, pa.list_(pa.float64())), pa.array(errors, pa.string())], names=[*keys, "x", "error"])

    return in_arrow(files.select(*keys, F.col(content)), run, schema)


def fitted(rows: DataFrame, key: str, label: str, most: int | None = None, features=None, **options) -> str:
    """The text of a machine fitted on all of (key, x, label), whose rows are read three times.

    ``features`` makes rows with x of rows without, once. Given ``most``, it is the exact dual's of at most so many rows, those
    with the least hashes of their keys; ``features`` then sees little more than these. Hashes are cut off where about twice
    as many rows are left, so that the driver gets no more than these from however many partitions.
    """
    if most is None:
        return waves.fit(stored(features(rows), "vectors") if features else rows, key, label, **options).machine().dumped()
    h = F.md5(F.col(key).cast("string"))
    share = 2 * most / max(1, rows.where(F.col(label).isNotNull()).count())
    while True:
        part = rows if share >= 1 else rows.where(h < f"{int(share * 16**8):08x}")
        part = features(part) if features else part
        some = part.where(F.col("x").isNotNull() & F.col(label).isNotNull()).select("x", label, h.alias("h")).orderBy("h").limit(most).collect()
        if share >= 1 or len(some) == most:
            break
        share *= 4
    return kernel.fit(np.array([r[0] for r in some]), np.array([bool(r[1]) for r in some]), **options).dumped()


def judged(rows: DataFrame, columns: tuple[str, ...], found, machine: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, closed, p_open, error) by what ``found`` makes of a batch of keys and columns: a vector of each row, or why it has none."""
    shared = rows.sparkSession.sparkContext.broadcast(machine)
    schema = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys) + ", closed boolean, p_open double, error string"

    def run(batches):
        for batch in parts(batches, len(keys)):
            out = []
            for x in found(batch):
                p = None if isinstance(x, ValueError) else float(machine_of(shared.value).probabilities(x[None])[0])
                out.append((p is not None and p < 0.5, p, str(x)[:200] if p is None else None))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), *(pa.array(c, t) for c, t in zip(cols, (pa.bool_(), pa.float64(), pa.string()), strict=True))], names=[*keys, "closed", "p_open", "error"])

    return in_arrow(rows.select(*keys, *columns), run, schema)


def predictions(files: DataFrame, machine: str, keys: tuple[str, ...], families: tuple[str, ...] = FAMILIES, content: str = "content") -> DataFrame:
    """(keys, closed, p_open, error) of image files by a machine that is broadcast once. Works on tables and streams.

    A file that can't be read counts as an open eye, as an unknown state does, and says why.
    """
    return judged(files, (content,), lambda batch: featured(batch.column(len(keys)).to_pylist(), families), machine, keys)


def classified(rows: DataFrame, machine: str, keys: tuple[str, ...]) -> DataFrame:
    """The same of (keys, x, error) that ``vectors`` has made of the files."""
    return judged(rows, ("x", "error"), lambda batch: [ValueError(e) if x is None else np.array(x) for x, e in zip(*(batch.column(len(keys) + i).to_pylist() for i in (0, 1)), strict=True)], machine, keys)
