"""Baseline JPEG of gray images, written and read in numpy for whole stacks of images at once.

Writing: blocks are transformed, quantised and put into zigzag order by array operations; the runs and sizes of all images
become one table of codes, sorted by image, block and place, whose bits are laid out at once. Reading goes through all
images in lock step: each step reads the next code of every image that is not done.
"""

from __future__ import annotations

import functools
import math
import re
import struct

import numpy as np

#: Fixed values of the standard (annex K): luminance quantisation, row by row.
LUMINANCE = np.array([
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]).reshape(8, 8)
#: Fixed values of the standard (annex K.3): numbers of codes of 1, 2, ... 16 bits for sizes of mean values (0 to 11 in turn)
#: and for runs and sizes of the others, whose 37 shortest codes are listed; all others follow in ascending order.
MEAN_CODES = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
OTHER_CODES = [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]
OTHER_SHORT = [
    0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14,
    0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82,
]
MEAN_SYMBOLS = list(range(12))
OTHER_SYMBOLS = OTHER_SHORT + sorted({0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))} - set(OTHER_SHORT))
#: Pixels that are transformed back at once.
PIXELS = 1 << 18
QUALITIES = (5, 10, 15, 20, 25, 30, 40, 50, 60, 70, 80, 90, 95)

#: Row-major places in zigzag order: diagonals in turn, every other one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
BASIS = np.array([[math.sqrt((1 if u == 0 else 2) / 8) * math.cos(math.pi * (2 * x + 1) * u / 16) for x in range(8)] for u in range(8)])
#: Bits of the absolute values of coefficients.
SIZES = np.array([v.bit_length() for v in range(1 << 12)])


def scaled_table(quality: int) -> np.ndarray:
    """The quantisation table for a quality; those outside of 1 to 100 count as the nearest of them."""
    q = min(max(int(quality), 1), 100)
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return np.clip((LUMINANCE * scale + 50) // 100, 1, 255)


def canonical(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by symbol: codes of a length follow one another, a bit is added between lengths."""
    codes, lengths, code, at = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for bits, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            codes[s], lengths[s] = code, bits
            code += 1
        at += n
        code <<= 1
    return codes, lengths


MEAN, OTHER = canonical(MEAN_CODES, MEAN_SYMBOLS), canonical(OTHER_CODES, OTHER_SYMBOLS)


def blocks_of(stack: np.ndarray) -> np.ndarray:
    """n x blocks x 8 x 8 of images filled up to multiples of 8 by their last rows and columns."""
    n, h, w = stack.shape
    p = np.pad(stack, ((0, 0), (0, -h % 8), (0, -w % 8)), "edge")
    return p.reshape(n, p.shape[1] // 8, 8, p.shape[2] // 8, 8).swapaxes(2, 3).reshape(n, -1, 8, 8)


def quantised(stack: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised coefficients, n x blocks x 8 x 8; halves away from zero."""
    c = np.round((BASIS @ (blocks_of(stack).astype(float) - 128) @ BASIS.T) / table, 6)
    return (np.sign(c) * np.floor(np.abs(c) + 0.5)).astype(np.int64)


def pixels_of(coefficients: np.ndarray, table: np.ndarray, h: int, w: int) -> np.ndarray:
    """Images of quantised coefficients."""
    n = len(coefficients)
    p = np.floor(np.round(BASIS.T @ (coefficients * table) @ BASIS, 6) + 128.5).clip(0, 255).astype(np.uint8)
    p = p.reshape(n, -(-h // 8), -(-w // 8), 8, 8).swapaxes(2, 3).reshape(n, -(-h // 8) * 8, -(-w // 8) * 8)
    return p[:, :h, :w]


def codes_of(coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of all images in order: image, value and number of bits, each a code with the bits that follow it."""
    n, blocks = coefficients.shape[:2]
    z = coefficients.reshape(n, blocks, 64)[:, :, ZIGZAG]
    z[:, :, 0] = np.diff(z[:, :, 0], prepend=0, axis=1)
    flat = z.reshape(n * blocks, 64)
    own = np.arange(n * blocks)

    def events(table, block, place, symbol, value):
        """One code each; negative values are given by the bits of the value below."""
        size = symbol & 15
        extra = np.where(value < 0, value - 1, value) & ((1 << size) - 1)
        return block * 65 + place, table[0][symbol] << size | extra, table[1][symbol] + size

    block, place = np.nonzero(flat[:, 1:])
    place, value = place + 1, flat[block, place + 1]
    fresh = np.diff(block, prepend=-1) > 0
    run = place - np.where(fresh, 0, np.concatenate([[0], place[:-1]])) - 1
    long = np.repeat(np.arange(len(run)), run // 16)  # sixteen zeros each
    last = np.zeros(len(own), np.int64)
    last[block] = place  # the last one stays
    open_ = own[last < 63]
    none = lambda like: np.zeros(len(like), np.int64)
    parts = [
        events(MEAN, own, none(own), SIZES[np.abs(flat[:, 0])], flat[:, 0]),
        events(OTHER, block[long], place[long], none(long) + 0xF0, none(long)),
        events(OTHER, block, place, (run % 16) << 4 | SIZES[np.abs(value)], value),
        events(OTHER, open_, none(open_) + 64, none(open_), none(open_)),
    ]
    key, bits, length = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")  # runs of zeros stand before the value behind them
    return key[order] // (65 * blocks), bits[order], length[order]


def head(table: np.ndarray, h: int, w: int) -> bytes:
    part = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    huffman = lambda kind, counts, symbols: part(0xC4, bytes([kind, *counts, *symbols]))
    return b"".join([
        b"\xff\xd8",
        part(0xE0, b"JFIF\0" + bytes([1, 1, 0, 0, 1, 0, 1, 0, 0])),
        part(0xDB, bytes([0, *table.ravel()[ZIGZAG].tolist()])),
        part(0xC0, struct.pack(">BHHB", 8, h, w, 1) + bytes([1, 0x11, 0])),
        huffman(0x00, MEAN_CODES, MEAN_SYMBOLS),
        huffman(0x10, OTHER_CODES, OTHER_SYMBOLS),
        part(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ])


def encode(stack: np.ndarray, quality: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Files of a stack of images, and how many codes and bits their scans have."""
    n, h, w = stack.shape
    if not (n and 0 < h < 65536 and 0 < w < 65536):
        if n:
            raise ValueError(f"no file can hold {h} x {w} pixels")
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = scaled_table(quality)
    image, value, length = codes_of(quantised(stack, table))
    n_codes, n_bits = np.bincount(image, minlength=n), np.bincount(image, length, n).astype(np.int64)
    pad = -n_bits % 8  # ones fill the last byte
    end = np.cumsum(np.bincount(image, minlength=n))
    value, length = np.insert(value, end, (1 << pad) - 1), np.insert(length, end, pad)
    shift = np.repeat(np.cumsum(length), length) - 1 - np.arange(length.sum())
    raw = np.packbits((np.repeat(value, length) >> shift & 1).astype(np.uint8)).tobytes()
    ends = np.cumsum((n_bits + pad) // 8).tolist()
    first = head(table, h, w)
    files = [first + raw[i:j].replace(b"\xff", b"\xff\0") + b"\xff\xd9" for i, j in zip([0, *ends], ends)]
    return files, n_codes, n_bits


def parse(data: bytes) -> dict:
    """Size, tables and scan of a file; what is not a baseline file of one gray plane is an error."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    at, found = 2, {"tables": {}, "codes": {}}
    try:
        while True:
            if data[at] != 0xFF:
                raise ValueError(f"no marker at byte {at}")
            while data[at + 1] == 0xFF:
                at += 1
            mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if len(body) != size - 2:
                raise ValueError("the file ends early")
            if mark == 0xDB:
                while body:
                    if body[0] >> 4:
                        raise ValueError("quantisation tables of 16 bits are not read")
                    table = np.zeros(64, np.int64)
                    table[ZIGZAG] = list(body[1:65])
                    found["tables"][body[0] & 15], body = table.reshape(8, 8), body[65:]
            elif mark == 0xC4:
                while body:
                    n = sum(body[1:17])
                    found["codes"][body[0]], body = (tuple(body[1:17]), tuple(body[17 : 17 + n])), body[17 + n :]
            elif mark == 0xC0:
                depth, h, w, planes = struct.unpack_from(">BHHB", body)
                if depth != 8 or planes != 1 or not h or not w:
                    raise ValueError("only gray images of 8 bits are read")
                found |= {"h": h, "w": w, "table": body[8]}
            elif 0xC1 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
                raise ValueError("only baseline files are read")
            elif mark == 0xDD and any(body):
                raise ValueError("restart intervals are not read")
            elif mark == 0xDA:
                end = re.compile(rb"\xff[^\0]").search(data, at)
                scan = data[at : end.start() if end else len(data)].replace(b"\xff\0", b"\xff")
                mean, other = body[2] >> 4, body[2] & 15
                return {"h": found["h"], "w": found["w"], "table": found["tables"][found["table"]], "mean": found["codes"][mean], "other": found["codes"][16 | other], "scan": scan}
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError(f"a damaged JPEG file: {e!r}") from e


@functools.lru_cache(16)
def lookup(codes: tuple) -> np.ndarray:
    """For each 16 bits that may come: length << 8 | symbol of the code they begin with; 0 where no code does."""
    code, length = canonical(*map(list, codes))
    table = np.zeros(1 << 16, np.int64)
    for s in codes[1]:
        room = 16 - length[s]
        table[code[s] << room : (code[s] + 1) << room] = length[s] << 8 | s
    return table


def decode(files: list[bytes]) -> list[np.ndarray | ValueError]:
    """The images of files; in place of one that can't be read, its error."""
    out: list = [None] * len(files)
    alike: dict[tuple, list] = {}
    for i, data in enumerate(files):
        try:
            p = parse(data)
            alike.setdefault((p["h"], p["w"], p["mean"], p["other"]), []).append((i, p))
        except ValueError as e:
            out[i] = e
    for (h, w, mean, other), group in alike.items():
        coefficients, good = scans([p["scan"] for _, p in group], -(-h // 8) * -(-w // 8), lookup(mean), lookup(other))
        tables, step = np.stack([p["table"] for _, p in group])[:, None], max(1, PIXELS // (h * w))
        images = (image for j in range(0, len(group), step) for image in pixels_of(coefficients[j : j + step], tables[j : j + step], h, w))
        for (i, _), image, ok in zip(group, images, good, strict=True):
            out[i] = image if ok else ValueError("a damaged scan")
    return out


def scans(raw: list[bytes], blocks: int, mean: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients of scans with the same codes, and which scans are whole."""
    n = len(raw)
    data = np.frombuffer(b"".join(r + b"\xff" * 6 for r in raw), np.uint8).astype(np.int64)
    base = np.cumsum([0, *(len(r) + 6 for r in raw)])[:-1]
    limit = np.array([8 * len(r) for r in raw])
    at, block, place, before = (np.zeros(n, np.int64) for _ in range(4))
    good, out, both = np.ones(n, bool), np.zeros((n, blocks, 64), np.int64), np.concatenate([mean, other])
    live = np.arange(n)

    def peek(image, bit):
        """The 16 bits that come next."""
        byte = base[image] + (bit >> 3)
        return (data[byte] << 16 | data[byte + 1] << 8 | data[byte + 2]) >> (8 - (bit & 7)) & 0xFFFF

    while len(live):
        first = place[live] == 0
        code = both[peek(live, at[live]) + np.where(first, 0, 1 << 16)]
        length, symbol = code >> 8, code & 255
        run, size = np.where(first, 0, symbol >> 4), symbol & 15
        bit = at[live] + length
        bad = (length == 0) | (bit + size > limit[live]) | (size > 11)
        extra = peek(live, np.minimum(bit, limit[live])) >> (16 - size)
        value = np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra) * (size > 0)
        at[live] = bit + size
        mean_value = before[live] + value
        before[live] = np.where(first, mean_value, before[live])
        to = place[live] + run
        end = ~first & (size == 0) & (run < 15)
        bad |= ~end & (to > 63)
        put = ~bad & ~end & (first | (size > 0))
        some = live[put]
        out[some, block[some], ZIGZAG[to[put]]] = np.where(first, mean_value, value)[put]
        place[live] = np.where(end, 64, to + 1)
        done = place[live] > 63
        block[live[done]] += 1
        place[live[done]] = 0
        good[live[bad]] = False
        live = live[~bad & (block[live] < blocks)]
    return out.reshape(n, blocks, 8, 8), good
