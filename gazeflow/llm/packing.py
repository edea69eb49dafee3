"""Best-fit packing of tokenised documents into fixed-length sequences by minimum bin slack.

Only the histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus) reaches the driver. There each bin
starts with the longest length left, and a bitset subset-sum over the lengths at hand finds the fullest combination beside
it; that combination is taken as often as the histogram allows. Pieces then look up their place by their rank among the
pieces of equal length, which is a rank within a task plus the counts of the tasks before it.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .arrow import in_arrow, lean, map_rows, slices
from .tokens import WORD, PrefixCounter

ODD = re.compile("[\x1c-\x1f]")
#: Distinct chunks in a generation of those whose ids a worker keeps (and words), and bytes of text that are encoded at once.
CACHE, SLICE = 500_000, 2 << 20


class ChunkEncoder:
    """Ids of texts as little-endian 32-bit integers.

    White space never enters a token of this tokenizer, so each distinct chunk between it is encoded once: chunks are
    split into words as the tokenizer splits them, and the library merges the distinct new words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.merger = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.merger.normalizer = None
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def learn(self, chunks: list[str]) -> None:
        split, known = [], self.words
        for c in chunks:
            if c.isascii() and c.isalpha():  # most are: one word, or one and a stop
                split.append((c.lower(),))
            elif c[-1] in ".," and c[:-1].isalpha() and c.isascii():
                split.append((c[:-1].lower(), c[-1]))
            elif "<|" in c:  # perhaps a special string
                self.known[c] = np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
                split.append(None)
            else:
                split.append(WORD.findall(PrefixCounter.normal(c)))
        new = list({w for s in split if s for w in s if w not in known})
        for at in range(0, len(new), 256):
            some = new[at : at + 256]
            e = self.merger.encode(" ".join(some), add_special_tokens=False)
            ends = [0, *(np.flatnonzero(np.diff(e.word_ids)) + 1).tolist(), len(e.ids)]
            if len(ends) != len(some) + 1:
                raise ValueError("the tokenizer splits words differently")
            raw = np.array(e.ids, "<u4").tobytes()
            for w, i, j in zip(some, ends, ends[1:]):
                known[w] = raw[4 * i : 4 * j]
        for c, s in zip(chunks, split, strict=True):
            if s is not None:
                self.known[c] = known[s[0]] if len(s) == 1 else b"".join([known[w] for w in s])

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.split() if not ODD.search(t) else [p for p in regex.split(r"\p{White_Space}+", t) if p] for t in texts]
        if len(self.known) > CACHE:  # what is met again moves from the older generation to the younger, so frequent chunks stay
            self.before, self.known = self.known, {}
            if len(self.words) > CACHE:
                self.words = {}
        known, before = self.known, self.before
        new = []
        for c in set().union(*split).difference(known):
            if (old := before.get(c)) is None:
                new.append(c)
            else:
                known[c] = old
        if new:
            self.learn(new)
        return [b"".join(map(known.__getitem__, s)) for s in split]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def best_combination(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """The lengths, each at most as often as counted, whose sum comes closest to ``room`` from below; ``lengths`` falls."""
    reach, steps, all_below = 1, [], (1 << (room + 1)) - 1
    for n in lengths:
        if n > room:
            continue
        left, k = min(counts[n], room // n), 1
        while left:
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & all_below
            left -= k
            k *= 2
        if reach >> room:
            break
    total, out = reach.bit_length() - 1, []
    for n, k, before in reversed(steps):
        if not before >> total & 1:
            total -= n * k
            out += [n] * k
    return out


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Places for all pieces of a length histogram, and the number of sequences.

    A row (length, first rank, first sequence, pieces per sequence, offset) says where pieces of that length go from that
    rank on: rank r goes to sequence first + (r - rank) // per, at offset + (r - rank) % per * length.
    """
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    lengths = sorted(left, reverse=True)
    rows, sequences = [], 0
    while lengths:
        longest = lengths[0]
        left[longest] -= 1
        bin_ = [longest, *best_combination(lengths, left, capacity - longest)]
        left[longest] += 1
        own: dict[int, int] = {}
        for n in bin_:
            own[n] = own.get(n, 0) + 1
        times, offset = min(left[n] // k for n, k in own.items()), 0
        for n, k in own.items():
            rows.append((n, used[n], sequences, k, offset))
            used[n] += k * times
            left[n] -= k * times
            offset += n * k
        sequences += times
        if not all(map(left.get, own)):
            lengths = [n for n in lengths if left[n]]
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequences


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str, keep: bool) -> DataFrame:
    """Pieces of all documents with their task and their rank among that task's pieces of equal length."""
    schema = f"{id_col} long, piece int, start long, length long, ids_crc32 long, ids binary, task int, local long"

    @lean
    def make(batches):
        from pyspark import TaskContext

        e, task, end, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes(), {}
        step = capacity * 4
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), e.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    for i in range(0, len(ids), step):
                        own = ids[i : i + step]
                        n = len(own) // 4
                        rank = seen[n] = seen.get(n, -1) + 1
                        rows.append((doc, i // step, i // 4, n, zlib.crc32(own), own if keep else None, task, rank))
                if rows:
                    cols = zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).transform(in_arrow, make, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. Only documents longer than a sequence are
    cut. Returns per piece: the id, piece, start, length, ids_crc32, sequence_id, offset and ids (32-bit, little-endian; null
    unless ``keep``). Sequences have no gaps from offset 0. Repeated rows are packed each, null ids stay null, no rows give
    no rows, and other columns are not read.
    """
    cut = stored(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, keep), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    places, _ = plan(histogram, capacity)
    base = by_task.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).select("length", "task", F.coalesce("base", F.lit(0)).alias("base"))
    ranked = cut.join(base, ["length", "task"]).select(id_col, "piece", "start", "length", "ids_crc32", "ids", (F.col("base") + F.col("local")).alias("rank"))
    names = (id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")
    first = places[:, 0] << 44 | places[:, 1]

    def make():
        def run(part: pa.RecordBatch) -> list:
            length, rank = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 6))
            row = places[np.searchsorted(first, length << 44 | rank, "right") - 1]
            nth = rank - row[:, 1]
            return [*(part.column(i) for i in range(5)), pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length), part.column(5)]

        return run

    return map_rows(ranked, make, f"{id_col} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary").select(*names)
