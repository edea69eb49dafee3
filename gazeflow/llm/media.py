"""Media columns: Netpbm and BMP images as numpy arrays, area-resized by integral images, stored as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows

#: Samples in a row of a stored payload.
WIDTH = 64


def to_pgm(gray: np.ndarray) -> bytes:
    """Binary Netpbm of 8-bit gray (2-D) or colour (3-D) samples."""
    h, w = gray.shape[:2]
    return b"P%d\n%d %d\n255\n" % (5 if gray.ndim == 2 else 6, w, h) + np.ascontiguousarray(gray, np.uint8).tobytes()


def from_netpbm(data: bytes) -> np.ndarray:
    """Samples of a P1 to P6 file as height x width (x 3); bits of P1 and P4 are 1 for black, as stored."""
    head = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")
    kind, at = data[:2], 2
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("not Netpbm")
    k, found = int(kind[1:]), []
    for _ in range(2 if k in (1, 4) else 3):
        m = head.match(data, at)
        if m is None:
            raise ValueError("a short Netpbm header")
        found.append(int(m[1]))
        at = m.end()
    w, h, most = [*found, 1][:3]
    if not (0 < w < 1 << 31 and 0 < h < 1 << 31 and 0 < most < 65536):
        raise ValueError("impossible size or depth")
    depth = 3 if k in (3, 6) else 1
    if k in (1, 2, 3):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        flat = np.frombuffer(b"".join(body.split()), np.uint8)[: h * w] - 48 if k == 1 else np.array(body.split(), np.int64)[: h * w * depth]
        if len(flat) < h * w * depth or flat.min() < 0 or flat.max() > most:
            raise ValueError("samples are missing or out of range")
    else:
        body = data[at + 1 :]
        if k == 4:
            flat = np.unpackbits(np.frombuffer(body, np.uint8, h * ((w + 7) // 8)).reshape(h, -1), axis=1)[:, :w].ravel()
        else:
            flat = np.frombuffer(body, np.uint8 if most < 256 else ">u2", h * w * depth)
    out = flat[: h * w * depth].astype(np.uint8 if most < 256 else np.uint16)
    return out.reshape((h, w, 3) if depth == 3 else (h, w))


def to_bmp(pixels: np.ndarray) -> bytes:
    """Uncompressed BMP: 8-bit with a gray palette (2-D) or 24-bit (3-D, RGB)."""
    h, w = pixels.shape[:2]
    gray = pixels.ndim == 2
    rows = (pixels if gray else pixels[:, :, ::-1]).reshape(h, -1)[::-1]
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4))).astype(np.uint8)
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    palette[:, 3] = 0
    colours = palette.tobytes() if gray else b""
    start = 54 + len(colours)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + rows.size, 0, 0, start, 40, w, h, 1, 8 if gray else 24, 0, rows.size, 2835, 2835, 256 if gray else 0, 0) + colours + rows.tobytes()


def from_bmp(data: bytes) -> np.ndarray:
    """Samples of an uncompressed 8-, 24- or 32-bit BMP; an 8-bit one with a gray palette gives a 2-D array."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    start, head, w, h = struct.unpack_from("<IIii", data, 10)
    bits, packed = struct.unpack_from("<HI", data, 28)
    if packed or bits not in (8, 24, 32):
        raise ValueError("this kind of BMP is not read")
    if w <= 0 or h == 0:
        raise ValueError("impossible size")
    n = bits // 8
    rows = np.frombuffer(data, np.uint8, abs(h) * ((w * n + 3) // 4 * 4), start).reshape(abs(h), -1)[:, : w * n]
    rows = rows[::-1] if h > 0 else rows
    if n > 1:
        return np.ascontiguousarray(rows.reshape(abs(h), w, n)[:, :, 2::-1])
    used = struct.unpack_from("<I", data, 46)[0] or 256
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
    if (palette == palette[:, :1]).all():
        return palette[:, 0][rows]
    return palette[rows]


def area_resize(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area under each target pixel, from an integral image with linear interpolation at its borders."""
    h, w = gray.shape
    total = np.zeros((h + 1, w + 1), np.int64)
    np.cumsum(gray, 0, np.int64, out=total[1:, 1:])
    np.cumsum(total[1:, 1:], 1, out=total[1:, 1:])

    def at(edges: np.ndarray, table: np.ndarray) -> np.ndarray:
        low = np.minimum(np.floor(edges).astype(int), len(table) - 2)
        part = (edges - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    ys, xs = np.arange(height + 1) * (h / height), np.arange(width + 1) * (w / width)
    grid = at(xs, at(ys, total).T).T
    return (grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]) / (h / height * w / width)


def to_npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def decode(data: bytes) -> np.ndarray:
    """A Netpbm, BMP or NPY image as an array of rows and columns of numbers, perhaps of three samples each."""
    image = from_bmp(data) if data[:2] == b"BM" else from_npy(data) if data[:6] == b"\x93NUMPY" else from_netpbm(data)
    if image.dtype.kind not in "uif" or image.ndim not in (2, 3) or image.ndim == 3 and image.shape[2] != 3 or 0 in image.shape:
        raise ValueError("not an image")
    return image


def difference_hash(tile: np.ndarray) -> str:
    """64 bits, one for each step to the right in a 8 x 9 tile that gets brighter."""
    return np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes().hex()


def features(image: np.ndarray) -> tuple[bytes, str]:
    """The 8 x 9 NPY tile of an image and its difference hash."""
    gray = image if image.ndim == 2 else image.astype(np.uint32) @ np.array([299, 587, 114], np.uint32) // 1000
    tile = np.round(area_resize(gray, 8, 9), 3).astype(np.float32)
    data = to_npy(tile)
    return data, difference_hash(from_npy(data))


def image_features(images: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """Decode stored images: id, height, width, tile (NPY), dhash, error.

    Null, empty or unreadable data, impossible sizes and missing samples among them, give null features and say why in
    ``error``. Null and repeated ids stay as they are, a row each; no rows give no rows, and other columns are not read.
    """

    def make():
        def one(data: bytes | None) -> tuple:
            try:
                image = decode(data or b"")
                return (*image.shape[:2], *features(image), None)
            except (ValueError, OverflowError, MemoryError, struct.error, EOFError) as e:
                return None, None, None, None, str(e)[:200]

        def run(part: pa.RecordBatch) -> list:
            cols = list(zip(*map(one, part.column(1).to_pylist()), strict=True))
            return [part.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()), strict=True))]

        return run

    return map_rows(images.select(F.col(id_col).cast("long").alias(id_col), F.col(data_col).alias(data_col)), make, f"{id_col} long, height int, width int, tile binary, dhash string, error string", text=1)


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Store each text's UTF-8 bytes, padded by zeros to a positive multiple of 64, as a gray image 64 wide; read it back.

    Returns id, n_bytes (unpadded), payload_bytes, payload_sha256 and tail_crc32 (of the bytes read back), media_bytes and
    media_sha256 (of the stored image), feature (difference hash of its tile), media and tile (null unless ``keep``). A
    null or empty text is one row of zeros. Equal texts give equal values. Null and repeated ids stay as they are, a row each; no
    rows give no rows, and other columns are not read.
    """
    schema = f"{id_col} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary, tile binary"
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())

    def make():
        def one(text: str | None) -> tuple:
            raw = (text or "").encode()
            padded = raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))
            media = to_pgm(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH))
            image = decode(media)
            back = image.tobytes()
            tile, feature = features(image)
            return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, media if keep else None, tile if keep else None

        def run(part: pa.RecordBatch) -> list:
            cols = list(zip(*map(one, part.column(1).to_pylist()), strict=True))
            return [part.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))]

        return run

    return map_rows(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)), make, schema, text=1)
