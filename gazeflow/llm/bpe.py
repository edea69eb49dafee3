"""Byte-level BPE by replaying the merges over all distinct words of a slice of the corpus at once.

An inverted index maps each token pair to the places where it stands. Merges are applied in rank order: all places of
the lowest pair at a time, and only the pairs with the touched neighbours are looked up and indexed anew.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows

#: Pieces of white space and what follows it; no match of the word pattern crosses their borders.
PIECE = re.compile(r"\s*\S+|\s+")
#: ``re`` takes these for white space, the word pattern does not.
ODD = re.compile("[\x1c-\x1f]")
#: Distinct pieces in a generation of a worker's memory, and pieces that one replay takes.
CACHE, REPLAYED = 250_000, 300_000


def ordered(parts: list[np.ndarray]) -> np.ndarray:
    """The distinct values of some arrays in ascending order."""
    x = np.concatenate(parts)
    x.sort()
    if len(x) < 2:
        return x
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


class MergeTable:
    """Ranks of a rank file, and for each pair of tokens the token it merges into (which is also the merge's rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.size = max(self.ids.values()) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for t, i in self.ids.items():
            self.bytes[i] = t
        pairs = sorted((self.ids[t[:k]] * self.size + self.ids[t[k:]], i) for t, i in self.ids.items() for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids)
        self.keys, self.into = (np.array([p[n] for p in pairs], np.int64) for n in (0, 1))
        self.byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair merges into, -1 where it doesn't."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.into[at], -1)

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Encode all words together."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        n = int(starts[-1])
        sym = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[starts[1:][sizes > 0] - 1] = -1
        prv[starts[:-1][sizes > 0]] = -1
        into = np.full(n, -1)  # the token that the pair starting at a place merges into
        left = np.flatnonzero(nxt >= 0)
        into[left] = self.merged(sym[left], sym[left + 1])
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def add(places: np.ndarray) -> None:
            tokens = into[places]
            order = np.argsort(tokens, kind="stable")
            places, tokens = places[order], tokens[order]
            first = int(np.searchsorted(tokens, 0))
            if first == len(tokens):
                return
            cuts = np.flatnonzero(np.diff(tokens[first:])) + 1 + first
            for a, b in zip([first, *cuts], [*cuts, len(tokens)], strict=True):
                t = int(tokens[a])
                if t not in index:
                    index[t] = []
                    heapq.heappush(waiting, t)
                index[t].append(places[a:b])

        add(left)
        while waiting:
            t = heapq.heappop(waiting)
            found = index.pop(t)
            places = found[0] if len(found) == 1 else ordered(found)
            places = places[into[places] == t]  # others have changed since
            if not len(places):
                continue
            if len(places) > 1:  # of overlapping places the first wins
                after = nxt[places]
                clash = np.flatnonzero(places[np.minimum(np.searchsorted(places, after), len(places) - 1)] == after)
                if len(clash):
                    taken, keep = set(), []
                    for p, q in zip(places.tolist(), after.tolist(), strict=True):
                        if p not in taken:
                            keep.append(p)
                            taken.add(q)
                    places = np.array(keep)
            gone = nxt[places]
            after = nxt[gone]
            sym[places] = t
            sym[gone] = into[gone] = -1
            nxt[places] = after
            has = after >= 0
            prv[after[has]] = places[has]
            into[places] = -1
            right, before = places[has], prv[places]
            before = before[before >= 0]
            touched = ordered([right, before])
            if len(touched):
                into[touched] = self.merged(sym[touched], sym[nxt[touched]])
                add(touched)
        alive = sym >= 0
        ids, ends = sym[alive].tolist(), np.concatenate([[0], np.cumsum(alive)])[starts]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class Encoder:
    """Encodes texts by the merges of a rank file, each match of ``pattern`` by itself, and decodes ids."""

    def __init__(self, path: str, pattern: str):
        self.table = MergeTable(path)
        self.names = list(map(str, range(self.table.size)))
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.pieces: dict[str, tuple[int, str, str]] = {}
        self.before: dict[str, tuple[int, str, str]] = {}

    def prepare(self, pieces: set[str]) -> None:
        """Encode the pieces that are not known yet, all their words in one replay.

        What is known is kept in two generations: once the younger is full it becomes the older, and what is met again moves
        over, so that frequent pieces stay.
        """
        known, before = self.pieces, self.before
        new = []
        for p in pieces.difference(known):
            if (old := before.get(p)) is None:
                new.append(p)
            else:
                known[p] = old
        for at in range(0, len(new), REPLAYED):
            self.encode_pieces(new[at : at + REPLAYED])

    def encode_pieces(self, new: list[str]) -> None:
        words: dict[str, int] = {}
        split = []
        for p in new:
            # a space, if any, and letters are one word
            one = p.isascii() and (p.isalpha() or p[0] == " " and p[1:].isalpha())
            split.append([words.setdefault(w, len(words)) for w in ((p,) if one else self.pattern.findall(p))])
        ids = self.table.replay([w.encode() for w in words])
        names, token = self.names, self.table.bytes
        for p, s in zip(new, split, strict=True):
            own = ids[s[0]] if len(s) == 1 else [i for w in s for i in ids[w]]
            back = b"".join([token[i] for i in own]).decode()
            self.pieces[p] = (len(own), ",".join([names[i] for i in own]), p if back == p else back)

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text the number of its ids, the ids joined by commas and the text that they decode to."""
        split = [PIECE.findall(t) if not ODD.search(t) else [t] if t else [] for t in texts]
        self.prepare({p for s in split for p in s})
        known = self.pieces
        for s in split:
            counts, ids, back = zip(*map(known.__getitem__, s), strict=True) if s else ((), (), ())
            yield sum(counts), ",".join(ids), "".join(back)
        if len(known) > CACHE:
            self.before, self.pieces = known, {}


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_decode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Encode every text and decode its ids again.

    Returns per row: the id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded
    bytes), ids and decoded (null unless ``keep``). A null or empty text has no ids and decodes to nothing; repeated ids
    are encoded row by row, a null id stays null, no rows give no rows, and other columns are not read.
    """
    schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded binary"

    def make():
        e = encoder(ranks, pattern)

        def run(part: pa.RecordBatch) -> list:
            n, ids, decoded, lists = [], [], [], []
            for count, joined, back in e.encode([t or "" for t in part.column(1).to_pylist()]):
                raw = back.encode()
                n.append(count)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append((hashlib.sha256(raw).hexdigest(), raw if keep else None))
                lists.append((list(map(int, joined.split(","))) if joined else []) if keep else None)
            return [part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array([d[0] for d in decoded]), pa.array(lists, pa.list_(pa.int32())), pa.array([d[1] for d in decoded], pa.binary())]

        return run

    return map_rows(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)), make, schema, text=1)
