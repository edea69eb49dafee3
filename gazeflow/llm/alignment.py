"""Alignment of two tokenizers' tokens on the same text, and how often their token ids are linked in the corpus.

A slice of documents is cut where both tokenizers always start anew, in front of a single space; a distinct chunk is encoded
once. Its tokens become interval tables in DuckDB: an as-of join finds the ends that both share, a window sum numbers the
groups between them, another as-of join puts the second tokenizer's tokens into those groups, and grouped joins give the
linked ids of a chunk and of a document. Each slice hands Spark how many of its documents link an id pair. Spark adds these
partial counts up, finds the highest of each first id, and gives each slice the counts of its own pairs back, so that nothing
grows with the corpus in any task: a slice holds a few megabytes of text, or one longer document.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from .arrow import in_arrow, lean, slices
from .tokens import byte_symbols

#: A space between these starts a token in both encodings whatever stands around it.
SPLIT = re.compile(r"(?<=[^ ]) (?=\S)")
#: How byte-level vocabularies of this kind cut text, how the other marks a space, and its byte pieces.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE_MARK = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
#: Rows of id pairs in a batch.
PAIRS = 50_000
#: Bytes of text in a slice, distinct chunks that are encoded in one call, and chunks of documents whose pairs are counted at once.
SLICE, TOGETHER, BLOCK = 5 << 20, 100, 100_000


class ByteLevel:
    """A byte-level BPE vocabulary file; text in front of which a space is put. Special strings are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = {s: b for b, s in byte_symbols().items()}
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: Its tokens as bytes, by id; specials are not in the model's merges and never come out.
        self.bytes = {i: bytes(map(back.__getitem__, t)) for t, i in vocab.items() if all(c in back for c in t)}
        made = [vocab[a + b] for a, b in merges]
        self.library = None
        if made == sorted(made) and len(set(made)) == len(made):  # a merge's rank is its token's, which is faster to replay
            import tiktoken

            ranks = {self.bytes[i]: i for i in [*made, *(vocab[s] for s in back)]}
            self.encode = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.encode_special_tokens = True
            self.encode = lambda text: self.library.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        return self.encode(" " + text)


class Pieces:
    """A piece vocabulary that puts a space in front of text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = list(map(self.model.id_to_piece, range(n)))
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in names):
            raise ValueError("a piece reaches over a space, so texts can't be cut there")
        self.bytes = {}
        for i, p in enumerate(names):
            m = BYTE_PIECE.fullmatch(p) if self.model.is_byte(i) else None
            self.bytes[i] = bytes([int(m[1], 16)]) if m else p.replace(SPACE_MARK, " ").encode()

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text)


def joined(texts: pa.Array, offsets: np.ndarray, between: str) -> pa.Array:
    """Runs of texts that begin at the offsets, each as one text."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), texts), between)


class Aligner:
    """Encodes chunks with both tokenizers and aligns a slice of documents."""

    def __init__(self, first: str, second: str):
        import duckdb

        self.both = ByteLevel(first), Pieces(second)
        self.pieces = tuple(pa.array([t.bytes.get(i, b"") for i in range(max(t.bytes) + 1)], pa.binary()) for t in self.both)
        self.lengths = tuple(pc.binary_length(p).to_numpy().astype(np.int64) for p in self.pieces)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "preserve_insertion_order": "false"})

    def encoded(self, chunks: list[str], sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side the ids of all chunks (of ``sizes`` bytes) in turn and how many each has; none where a side's bytes are not the chunk's.

        The chunks are encoded as one text, in which they are parted as in their own texts, or one by one if that text changes.
        """
        text = " ".join(chunks)
        raw, ends, out = (" " + text).encode(), np.cumsum(1 + sizes), []
        for t, pieces, lengths in zip(self.both, self.pieces, self.lengths, strict=True):
            flat = np.array(t.ids(text), np.int64)
            stop = np.cumsum(lengths[flat])
            upto = np.searchsorted(stop, ends, "right")
            if not len(flat) or stop[-1] != len(raw) or not pieces.take(pa.array(flat)).buffers()[2].slice(0, len(raw)).equals(pa.py_buffer(raw)) or (stop[upto - 1] != ends).any():
                if len(chunks) == 1:
                    return [(np.zeros(0, np.int64), np.zeros(1, np.int64))] * 2
                each = [self.encoded([c], sizes[i : i + 1]) for i, c in enumerate(chunks)]
                return [tuple(np.concatenate([e[side][k] for e in each]) for k in (0, 1)) for side in (0, 1)]
            out.append((flat, np.diff(upto, prepend=0)))
        return out

    def tables(self, chunks: pa.Array) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        """Interval tables (i, c, id, s, e) of both encodings, all chunks on one line of byte offsets, tokens by chunk, and the order of the chunks.

        Chunks that begin or end with a space come last and are encoded by themselves.
        """
        alone = pc.or_(pc.starts_with(chunks, " "), pc.ends_with(chunks, " ")).to_numpy(zero_copy_only=False)
        order, plain = np.argsort(alone, kind="stable"), len(alone) - int(alone.sum())
        chunks = chunks.take(pa.array(order))
        texts, sizes = chunks.to_pylist(), pc.binary_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64)
        runs = [(i, min(i + TOGETHER, plain)) for i in range(0, plain, TOGETHER)] + [(i, i + 1) for i in range(plain, len(texts))]
        made = [self.encoded(texts[i:j], sizes[i:j]) for i, j in runs]
        out, counts = [], []
        for side, lengths in enumerate(self.lengths):
            ids, n = (np.concatenate([np.zeros(0, np.int64), *(m[side][k] for m in made)]) for k in (0, 1))
            end = np.cumsum(lengths[ids])
            counts.append(n)
            out.append(pa.table({"i": np.arange(len(ids), dtype=np.int32), "c": np.repeat(np.arange(len(n), dtype=np.int32), n), "id": ids.astype(np.int32), "s": end - lengths[ids], "e": end}))
        return *out, *counts, order

    def groups(self, a: pa.Table, b: pa.Table) -> None:
        """Tables ga and gb: the tokens with the number of their group. A group lies between ends that both share."""
        db = self.db
        db.register("a_in", a)
        db.register("b_in", b)
        db.execute("CREATE OR REPLACE TEMP TABLE a AS FROM a_in")
        db.execute("CREATE OR REPLACE TEMP TABLE b AS FROM b_in")
        db.unregister("a_in")
        db.unregister("b_in")
        db.execute("CREATE OR REPLACE TEMP TABLE met AS SELECT a.i, a.c, a.id, a.e, CAST(a.e = b.e AS INT) AS shared FROM a ASOF LEFT JOIN b ON a.e >= b.e")
        db.execute("CREATE OR REPLACE TEMP TABLE ga AS SELECT i, c, id, e, shared, sum(shared) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) - shared AS g FROM (SELECT i, c, id, e, coalesce(shared, 0) AS shared FROM met)")
        db.execute("CREATE OR REPLACE TEMP TABLE ends AS SELECT g, e FROM ga WHERE shared = 1")
        db.execute("CREATE OR REPLACE TEMP TABLE gb AS SELECT b.i, b.c, b.id, ends.g FROM b ASOF JOIN ends ON b.e <= ends.e")

    def overlaps(self, text: str) -> list[tuple[int, int]]:
        """Pairs of token numbers of one text, first and second tokenizer, whose bytes overlap."""
        a, b, *_ = self.tables(pa.array([text] if text else [], pa.string()))
        self.groups(a, b)
        return self.db.execute("SELECT a.i, b.i FROM a JOIN b ON a.s < b.e AND b.s < a.e ORDER BY 1, 2").fetchall()

    def align(self, texts: list[str | None]) -> dict:
        """All that a slice keeps, as arrays: by document, by document and distinct chunk (from own_from on), by chunk and link, by id pair."""
        db = self.db
        parts = [SPLIT.split(t) if t else [] for t in texts]
        per_doc = np.fromiter(map(len, parts), np.int64, len(parts))
        coded = pa.array([p for some in parts for p in some], pa.string()).dictionary_encode()
        a, b, n_a, n_b, order = self.tables(coded.dictionary)
        chunk = np.argsort(order)[coded.indices.to_numpy(zero_copy_only=False)]
        wrong = n_a == 0
        doc = np.repeat(np.arange(len(parts)), per_doc)
        good = np.ones(len(parts), bool)
        good[doc[wrong[chunk]]] = False
        doc, chunk = doc[good[doc]], chunk[good[doc]]
        self.groups(a, b)
        # what a chunk has, whichever document it is in
        db.execute("""CREATE OR REPLACE TEMP TABLE linked AS SELECT x.c, x.id AS a, y.id AS b, CAST(sum(x.n * y.n) AS BIGINT) AS n
FROM (SELECT g, c, id, count(*) AS n FROM ga GROUP BY ALL) x JOIN (SELECT g, id, count(*) AS n FROM gb GROUP BY ALL) y ON x.g = y.g GROUP BY ALL""")
        g_a, g_b = (db.execute(f"SELECT g FROM {t} ORDER BY i").fetchnumpy()["g"].astype(np.int64) for t in ("ga", "gb"))
        last = np.flatnonzero(np.diff(g_a, append=-1))  # of each group, the last token of the first side
        n_groups = np.bincount(a["c"].to_numpy()[last], minlength=len(n_a))
        sides = (joined(ids.cast(pa.string()), np.searchsorted(g, np.arange(len(last) + 1)), ",") for ids, g in ((a["id"].combine_chunks(), g_a), (b["id"].combine_chunks(), g_b)))
        names = joined(pc.binary_join_element_wise(*sides, "|"), np.cumsum(np.concatenate([[0], n_groups])), ";")
        # chunks of each document, once each with their number
        key, times = np.unique(doc << 32 | chunk, return_counts=True)
        own, own_chunk = key >> 32, key & 0xFFFFFFFF
        db.execute("CREATE OR REPLACE TEMP TABLE pairs AS SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS p FROM (SELECT DISTINCT a, b FROM linked)")
        links = db.execute("SELECT l.c, t.p, l.n FROM linked l JOIN pairs t ON t.a = l.a AND t.b = l.b ORDER BY l.c").fetchnumpy()
        pairs = db.execute("SELECT a, b FROM pairs ORDER BY p").fetchnumpy()
        # how many documents have a pair: its pairs with each of their chunks, once each, some documents at a time
        pair_n, bounds = np.zeros(len(pairs["a"]), np.int64), np.searchsorted(own, np.arange(len(parts) + 1))
        cuts = np.unique(np.append(bounds[np.searchsorted(bounds, np.arange(0, len(own), BLOCK))], len(own)))
        first, last = (np.searchsorted(links["c"], np.arange(len(n_a)), side) for side in ("left", "right"))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            low, n = first[own_chunk[i:j]], (last - first)[own_chunk[i:j]]
            step = np.arange(int(n.sum())) + np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            both = np.sort(np.repeat(own[i:j], n) << 32 | links["p"][step])
            pair_n += np.bincount((both & 0xFFFFFFFF)[np.diff(both, prepend=-1) > 0], minlength=len(pair_n))
        n_links = np.zeros(len(n_a), np.int64)
        np.add.at(n_links, links["c"], links["n"])
        offsets = np.searchsorted(doc, np.arange(len(parts) + 1))
        sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v[chunk])])[offsets])
        groups = joined(names.take(pa.array(chunk)), offsets, ";")
        return {
            "n_a": sums(n_a), "n_b": sums(n_b), "n_groups": sums(n_groups), "n_links": sums(n_links), "groups": groups,
            "own_from": bounds, "own_chunk": own_chunk, "own_times": times,
            "link_chunk": links["c"], "link_pair": links["p"], "link_n": links["n"], "pair_a": pairs["a"], "pair_b": pairs["b"], "pair_n": pair_n,
        }


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(first: str, second: str) -> Aligner:
    if (first, second) not in _ALIGNERS:
        _ALIGNERS[first, second] = Aligner(first, second)
    return _ALIGNERS[first, second]


#: A slice's rows: its documents (kind 0), its id pairs (kind 1), and one (kind 2) whose bytes say which links its documents have.
ROWS = "slice bigint, kind int, p int, a bigint, b bigint, n bigint, c bigint, d bigint, sha string, groups string, raw binary"
DOCUMENT, PAIR, LINKS = 0, 1, 2
INNER = ("own_from", "own_chunk", "own_times", "link_chunk", "link_pair", "link_n")


def aligned_slices(docs: DataFrame, first: str, second: str, id_col: str, text_col: str, keep: bool) -> DataFrame:
    """The rows of slices of documents, see ``ROWS``."""
    types = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in ROWS.split(", ")]

    def rows(number: int, kind: int, count: int, **cols) -> pa.RecordBatch:
        cols |= {"slice": np.full(count, number), "kind": np.full(count, kind)}
        made = [cols.get(c, pa.nulls(count, t)) for c, t in zip(names, types, strict=True)]
        return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(made, types, strict=True)], names=names)

    @lean
    def run(batches):
        from pyspark import TaskContext

        al, number = aligner(first, second), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                if not part.num_rows:
                    continue
                f, n = al.align(part.column(1).to_pylist()), part.num_rows
                sha = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in f["groups"].to_pylist()]
                yield rows(number, DOCUMENT, n, p=np.arange(n), a=part.column(0), b=f["n_a"], n=f["n_b"], c=f["n_groups"], d=f["n_links"], sha=sha, **({"groups": f["groups"]} if keep else {}))
                pairs = len(f["pair_a"])
                for i in range(0, pairs, PAIRS):
                    j = min(i + PAIRS, pairs)
                    yield rows(number, PAIR, j - i, p=np.arange(i, j), a=f["pair_a"][i:j].astype(np.int64), b=f["pair_b"][i:j].astype(np.int64), n=f["pair_n"][i:j])
                inner = [np.asarray(f[c]).astype("<i8" if c == "link_n" else "<i4") for c in INNER]
                yield rows(number, LINKS, 1, p=[pairs], raw=[zlib.compress(b"".join([np.array([len(x) for x in inner], "<i8").tobytes(), *(x.tobytes() for x in inner)]), 1)])
                del f, inner
                number += 1

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).transform(in_arrow, run, ROWS)


def inner_of(raw: bytes) -> dict[str, np.ndarray]:
    data, at, out = zlib.decompress(raw), 8 * len(INNER), {}
    for name, n in zip(INNER, np.frombuffer(data, "<i8", len(INNER)).tolist(), strict=True):
        kind = np.dtype("<i8" if name == "link_n" else "<i4")
        out[name] = np.frombuffer(data, kind, n, at).astype(np.int64)
        at += n * kind.itemsize
    return out


def pair_counts(cut: DataFrame) -> DataFrame:
    """(a, b, n, best) of all id pairs: how many documents link them, and whether no pair of the same first id has more."""
    each = stored(cut.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    top = each.groupBy("a").agg(F.max("n").alias("top"))
    return each.join(top, "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Align the tokens of a byte-level vocabulary (``first``) with those of a piece vocabulary (``second``) on every text.

    Returns per row: the id, n_a, n_b (tokens), n_groups, n_links (token pairs of a group), n_best (of these, those whose
    ids are linked in as many documents as any pair of the same first id), count_sum (over links, the documents that link
    the ids), groups_sha256 and groups (ids as ``a1,a2|b1;a3|b2,b3``; null unless ``keep``). A text that is null or empty, or
    that one tokenizer changes, has zeros and empty strings. Repeated rows are documents each, null ids stay null, no rows
    give no rows, and other columns are not read. A worker's memory grows with the longest text.
    """
    cut = stored(aligned_slices(docs, first, second, id_col, text_col, keep), "aligned")
    counts = pair_counts(cut)
    asked = cut.where(F.col("kind") == PAIR).select(F.col("slice").alias("to"), F.col("p").alias("place"), "a", "b")
    given = asked.join(counts, ["a", "b"]).select("to", "place", "n", "best")
    names = (id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        links, rows = left.filter(pc.equal(left["kind"], LINKS)), left.filter(pc.equal(left["kind"], DOCUMENT)).sort_by("p")
        f, pairs = inner_of(links["raw"][0].as_py()), links["p"][0].as_py()
        n, best, at = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64), right["place"].to_numpy()
        n[at], best[at] = right["n"].to_numpy(), right["best"].to_numpy(zero_copy_only=False)

        def total(value: np.ndarray) -> pa.Array:
            by_chunk = np.zeros(max(f["own_chunk"].max(initial=-1), f["link_chunk"].max(initial=-1)) + 1, np.int64)
            np.add.at(by_chunk, f["link_chunk"], f["link_n"] * value[f["link_pair"]])
            return pa.array(np.diff(np.concatenate([[0], np.cumsum(by_chunk[f["own_chunk"]] * f["own_times"])])[f["own_from"]]))

        return pa.table([*(rows[c] for c in ("a", "b", "n", "c", "d")), total(best), total(n), rows["sha"], rows["groups"]], names=names)

    schema = f"{id_col} bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, groups string"
    return cut.where(F.col("kind") != PAIR).groupBy("slice").cogroup(given.groupBy("to")).applyInArrow(finish, schema)
