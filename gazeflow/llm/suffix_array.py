"""Removal of repeated passages by suffix arrays built with difference covers.

Every string of ``window`` bytes that starts earlier in the corpus marks its later copies. Suffixes of the whole corpus would
be many times its size, so the text is first cut into overlapping content-defined stretches (see ``anchors``): every window
lies in one, and equal windows lie alike in stretches of one class. Stretches that equal an earlier one are repeats as a
whole, and one without a partner in its class cannot repeat. The suffixes of the rest, distinct stretches that share a
class, are sorted by the difference-cover algorithm: sampled triples are sorted and named, the names are sorted by
recursion, the remaining suffixes are merged in, and adjacent suffixes are compared by their first ``window`` bytes.
Classes are dealt to tasks as units; one of very many distinct stretches is dealt out window by window instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from .anchors import Stretches, U, mix
from .arrow import grouped, in_arrow, lean, slices

#: Distinct stretches of a class that one task sorts; those of larger classes are dealt out by window.
CLASS_ROWS = 2000
#: Bytes of stretches whose suffixes are sorted together (whole classes).
SORT_BYTES = 1 << 19
#: Bytes of text that are cut into stretches at once; working memory is about a hundred times that.
CUT_BYTES = 1 << 19
#: Stretches whose copies a task looks for at once before they are dealt out.
LOCAL_ROWS = 500_000
#: The place of documents without an id: after all others.
LAST = (1 << 63) - 1


def names_of(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of keys, equal ones alike, from 1 on."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), np.int64)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.cumsum(new)
    out = np.empty(len(keys), np.int64)
    out[order] = rank
    return out, int(rank[-1])


def suffix_ranks(s: np.ndarray, top: int) -> np.ndarray:
    """Rank (from 0) of each suffix of ``s``, whose symbols are 1 to ``top``; the end counts as 0.

    The difference cover is {1, 2} modulo 3: suffixes at these places are sorted by the names of their triples, recursively
    where names repeat; a suffix at the other places is its first symbol and a sampled suffix.
    """
    n = len(s)
    if n < 4:
        order = sorted(range(n), key=lambda i: s[i:].tolist())
        out = np.empty(n, np.int64)
        out[order] = np.arange(n)
        return out
    padded = np.concatenate([s, np.zeros(4, np.int64)])
    width = max(1, int(top).bit_length())
    if 3 * width > 63:
        raise ValueError("too many symbols are sorted together")
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # with one more place where the last sampled triple would touch the next part
    sampled = np.concatenate([one, two])
    triple = padded[sampled] << 2 * width | padded[sampled + 1] << width | padded[sampled + 2]
    names, most = names_of(triple)
    ranks = names - 1 if most == len(sampled) else suffix_ranks(names, most)
    rank = np.zeros(n + 4, np.int64)  # of sampled suffixes, from 1; beyond the end 0
    rank[sampled] = ranks + 1
    rank[n:] = 0
    zero = np.arange(0, n, 3)
    wide = int(rank.max()).bit_length()
    pair = padded[zero] << wide | rank[zero + 1]
    order = np.argsort(pair)
    zero, pair = zero[order], pair[order]
    one = one[one < n]
    # a suffix at place 0 or 1 is a symbol and a sampled suffix, one at 0 or 2 is two symbols and a sampled suffix
    by_one = one[np.argsort(rank[one])]
    by_two = two[np.argsort(rank[two])]
    key_one = padded[by_one] << wide | rank[by_one + 1]
    renamed = width + width + wide <= 63
    long = lambda i: padded[i] << (width + wide) | padded[i + 1] << wide | rank[i + 2]
    out = np.empty(n, np.int64)
    if renamed:
        key_two, key_zero = long(by_two), long(zero)
    else:  # names of pairs of symbols in place of the symbols
        both = np.concatenate([by_two, zero])
        head, _ = names_of(padded[both] << width | padded[both + 1])
        head = head << wide | rank[both + 2]
        key_two, key_zero = head[: len(by_two)], head[len(by_two) :]
    out[zero] = np.arange(len(zero)) + np.searchsorted(key_one, pair) + np.searchsorted(key_two, key_zero)
    place = np.empty(n + 4, np.int64)
    both = np.concatenate([by_one, by_two])
    both = both[np.argsort(rank[both])]
    place[both] = np.arange(len(both))
    out[by_one] = place[by_one] + np.searchsorted(pair, key_one)
    out[by_two] = place[by_two] + np.searchsorted(key_zero, key_two)
    return out


def repeated_windows(texts: list[bytes], places: np.ndarray, window: int) -> list[np.ndarray]:
    """For each stretch the starts of its windows that also start at an earlier place in another one.

    ``places`` are the stretches' places in the corpus, as ranks of documents shifted left by 40 bits plus offsets.
    """
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int64) + 2
    text[starts[1:] - 1] = 1
    n = len(text)
    order = np.empty(n, np.int64)
    order[suffix_ranks(text, 258)] = np.arange(n)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    inside = np.arange(n) - starts[owner]
    order = order[(sizes[owner] - inside >= window)[order]]  # suffixes that hold a whole window
    if len(order) < 2:
        return [np.zeros(0, np.int64)] * len(texts)
    # adjacent suffixes, eight bytes at a time
    eight = np.zeros(n + 8, np.int64)
    wide = np.concatenate([text - 2, np.zeros(16, np.int64)])
    for k in range(8):
        eight |= (wide[k : k + n + 8] & 255) << (8 * k)
    same = np.ones(len(order) - 1, bool)
    for at in [*range(0, window - 7, 8), *([window - 8] if window % 8 and window >= 8 else [])]:
        left = np.flatnonzero(same)
        same[left] = eight[order[left] + at] == eight[order[left + 1] + at]
    if window < 8:
        mask = (1 << 8 * window) - 1
        same = (eight[order[:-1]] & mask) == (eight[order[1:]] & mask)
    run = np.concatenate([[0], np.cumsum(~same)])
    place = places[owner[order]] + inside[order]
    first = np.minimum.reduceat(place, np.flatnonzero(np.concatenate([[True], ~same])))
    late = order[place > first[run]]
    late.sort()
    cut = np.searchsorted(late, starts)
    return [late[a:b] - s for a, b, s in zip(cut[:-1], cut[1:], starts[:-1], strict=True)]


def spans(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Windows as maximal runs of covered bytes."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.concatenate([cut, [len(starts) - 1]])] + window).tolist(), strict=True))


def placed(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Start and length in one number, ordered by start: what is dealt out once for every stretch of the corpus stays small."""
    return start << 32 | end - start


def stretch_table(docs: DataFrame, window: int) -> DataFrame:
    """Stretches (cls, own, doc, place); those that equal an earlier one of the same task have a null ``cls``."""
    names = ["cls", "own", "doc", "place"]

    @lean
    def run(batches):
        cut = Stretches(window)
        held: list[tuple] = []
        count = 0

        def flush():
            doc, start, end, cls, own = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((start, doc, own, cls))
            new = np.ones(len(order), bool)
            new[1:] = (cls[order][1:] != cls[order][:-1]) | (own[order][1:] != own[order][:-1])
            first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            late = np.zeros(len(order), bool)
            late[order] = (doc[order] != doc[first]) | (start[order] != start[first])
            keep = ~late
            yield pa.RecordBatch.from_arrays([pa.array(cls[keep].view(np.int64)), pa.array(own[keep].view(np.int64)), pa.array(doc[keep]), pa.array(placed(start[keep], end[keep]))], names=names)
            if late.any():
                ids = doc[late]
                # adjoining repeats of a document are one
                by = np.lexsort((start[late], ids))
                ids, s, e = ids[by], start[late][by], end[late][by]
                high = np.maximum.accumulate(e + (np.cumsum(np.concatenate([[0], ids[1:] != ids[:-1]])) << 40)) & ((1 << 40) - 1)
                new = np.ones(len(ids), bool)
                new[1:] = (ids[1:] != ids[:-1]) | (s[1:] > high[:-1])
                at = np.flatnonzero(new)
                stop = np.concatenate([at[1:], [len(ids)]]) - 1
                none = pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(ids[at]), pa.array(placed(s[at], high[stop]))], names=names)

        for batch in batches:
            for part in slices(batch, 1, CUT_BYTES):
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                ids = part.column(0).to_numpy()
                long = [i for i, t in enumerate(texts) if len(t) >= window]
                if not long:
                    continue
                of, start, _, end, cls, own = cut([texts[i] for i in long])
                held.append((ids[np.array(long)][of], start, end, cls, own))
                count += len(of)
                if count >= LOCAL_ROWS:
                    yield from flush()
                    held, count = [], 0
        if held:
            yield from flush()

    return docs.transform(in_arrow, run, "cls long, own long, doc long, place long")


def decided(stretches: DataFrame) -> DataFrame:
    """(kind, doc, start, end, cls): repeats (kind 0) and the distinct stretches of classes that hold several (1, and 2 if very many)."""
    columns = ("kind", "doc", "place", "cls")

    def made(kind, doc, place, cls):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), *map(pa.array, (doc, place, cls))], names=columns)

    @lean
    def run(batches):
        last: tuple | None = None  # class, hash, document and place of the first of the run at the end of a batch
        open_: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(3)]
        many: int | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cls, own, doc, place = (batch.column(i).to_numpy() for i in range(4))
            new = np.ones(len(cls), bool)
            new[1:] = (cls[1:] != cls[:-1]) | (own[1:] != own[:-1])
            if last is not None and last[:2] == (cls[0], own[0]):
                new[0] = False
            at = np.maximum.accumulate(np.where(new, np.arange(len(cls)), -1))
            fdoc = np.where(at >= 0, doc[at], last[2] if last else 0)
            fplace = np.where(at >= 0, place[at], last[3] if last else 0)
            late = (doc != fdoc) | (place != fplace)
            last = (cls[-1], own[-1], fdoc[-1], fplace[-1])
            if late.any():
                yield made(0, doc[late], place[late], cls[late])
            first = np.flatnonzero(new)
            rest = [np.concatenate([a, b[first]]) for a, b in zip(open_, (doc, place, cls), strict=True)]
            c = rest[2]
            if not len(c):
                continue
            edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            size = np.diff(np.concatenate([edge, [len(c)]]))
            per = np.repeat(size, size)
            ended = c != c[-1]
            big = ended & ((per > CLASS_ROWS) | (c == many if many is not None else False))
            some = ended & (per > 1) & ~big
            for kind, which in ((1, some), (2, big)):
                if which.any():
                    yield made(kind, *(x[which] for x in rest))
            open_ = [x[~ended] for x in rest]
            if many is not None and c[-1] != many:
                many = None
            if len(open_[2]) > CLASS_ROWS or many is not None:
                many = int(c[-1])
                if len(open_[2]):
                    yield made(2, *open_)
                open_ = [x[:0] for x in open_]
        if len(open_[2]) > 1:
            yield made(1, *open_)

    dealt = stretches.where("cls is not null").repartition("cls").sortWithinPartitions("cls", "own", "doc", "place")
    here = stretches.where("cls is null").select(F.lit(0).alias("kind"), "doc", "place", "cls")
    rows = dealt.transform(in_arrow, run, "kind int, doc long, place long, cls long").unionByName(here)
    start = F.shiftright("place", 32)
    return rows.select("kind", "doc", start.alias("start"), (start + F.col("place").bitwiseAND(F.lit((1 << 32) - 1))).alias("end"), "cls")


def with_lists(docs: DataFrame, rows: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """Documents with what stands in ``rows`` about them, as a list."""
    lists = rows.groupBy("doc").agg(F.collect_list(F.struct(*columns)).alias("list"))
    return docs.join(lists, "doc", how).select("doc", "text", "list")


def sorted_repeats(docs: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """(doc, start, end) of the repeats within distinct stretches of a class."""

    @lean
    def fetch(batches):
        for batch in batches:
            for part in slices(batch, 1):
                out: list[tuple] = []
                for doc, text, places in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    raw = (text or "").encode()
                    out += [(p["cls"], doc, p["start"], raw[p["start"] : p["end"]]) for p in places]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["cls", "doc", "start", "bytes"])

    schema = "cls long, doc long, start long, bytes binary"

    @lean
    def sort(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            docs_, start = rows.column(1).to_numpy(), rows.column(2).to_numpy()
            rank = np.unique(docs_, return_inverse=True)[1].astype(np.int64)
            found = repeated_windows(rows.column(3).to_pylist(), (rank << 40) + start, window)
            out = [(d, s + a, s + b) for d, s, w in zip(docs_.tolist(), start.tolist(), found, strict=True) for a, b in spans(w, window)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc", "start", "end"])

        for _, rows in grouped(batches, 1):
            held.append(rows)
            size += rows.nbytes
            if size >= SORT_BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    whole = with_lists(docs, asked.where("kind = 1"), "cls", "start", "end").transform(in_arrow, fetch, schema)
    return whole.repartition("cls").sortWithinPartitions("cls", "doc", "start").transform(in_arrow, sort, "doc long, start long, end long")


def dealt_repeats(docs: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """(doc, start, end) of the repeats within classes of very many distinct stretches: their windows are dealt out one by one."""
    cut = Stretches(window)

    @lean
    def windows(batches):
        for batch in batches:
            for part in slices(batch, 1):
                for doc, text, places in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    raw = np.frombuffer((text or "").encode(), np.uint8)
                    at = np.unique(np.concatenate([np.arange(p["start"], p["end"] - window + 1) for p in places]))
                    a, b = (r.range(r.sums(raw), at, at + window) for r in (cut.one, cut.two))
                    yield pa.RecordBatch.from_arrays([pa.array(mix(a + U(1)).view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(at), doc)), pa.array(at)], names=["a", "b", "doc", "start"])

    rows = stored(with_lists(docs, asked.where("kind = 2"), "cls", "start", "end").transform(in_arrow, windows, "a long, b long, doc long, start long"), "windows")
    firsts = rows.groupBy("a", "b").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first")
    late = rows.join(firsts, ["a", "b"]).where("doc <> first.doc or start <> first.start")
    return late.select("doc", "start", (F.col("start") + window).alias("end"))


def merged(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by some ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(places):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def repeats(docs: DataFrame, window: int) -> DataFrame:
    """(doc, start, end) of repeated bytes in documents (doc, text); ranges may overlap."""
    asked = stored(decided(stretch_table(docs, window)), "stretches")
    found = stored(sorted_repeats(docs, asked, window).union(dealt_repeats(docs, asked, window)).union(asked.where("kind = 0").select("doc", "start", "end")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("list")), "repeats")
    discard(asked)
    return found


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``_doc``, a row's place in the order of documents: its id, or for rows without one a place after all ids by their text's hash."""
    place = F.lit(LAST) - F.pmod(F.xxhash64(F.col(text_col).cast("string")), F.lit(1 << 40))
    return docs.withColumn("_doc", F.coalesce(F.col(id_col).cast("long"), place))


def kept_bytes(raw: bytes, places: list[dict] | None) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the maximal runs that go."""
    cut = merged([(p["start"], min(p["end"], len(raw))) for p in places or () if p["start"] < len(raw)])
    ends = [0, *(b for _, b in cut)]
    return b"".join([raw[e:a] for e, a in zip(ends, [*(a for a, _ in cut), len(raw)], strict=True)]), cut


def dedup(docs: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte that is covered by a string of ``window`` bytes which also starts earlier in the corpus.

    Documents are ordered by id; matches do not cross them, overlaps count, and all is judged on the input. Returns per row: the
    id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, spans (start and end of each run) and kept (the
    remaining bytes). A null text is empty. Rows without an id come last, in the order of a hash of their texts; rows of equal
    ids count as one document, whose equal places do not repeat each other. No rows give no rows, and other columns are not read.
    """
    given = keyed(docs.select(F.col(id_col).cast("long").alias("_given"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "_given", "text").withColumnRenamed("_doc", "doc")
    found = repeats(given.select("doc", "text"), window)
    joined = given.join(found, "doc", "left").select("_given", "text", "list")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())

    @lean
    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                out = []
                for text, places in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw = text.encode()
                    kept, cut = kept_bytes(raw, places)
                    out.append((len(raw), len(raw) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in cut], kept))
                if out:
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return joined.transform(in_arrow, run, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary")


def cut_repeats(docs: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs``, all columns, with repeated bytes cut from the texts and ``length_col`` set to the characters left.

    Bytes of a character that was cut in two go too. A document that had text and has none left is dropped; null and empty texts stay.
    """
    given = keyed(docs, id_col, text_col)
    found = repeats(given.select(F.col("_doc").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), window)
    joined = given.join(found.select(F.col("doc").alias("_doc"), F.col("list").alias("_list")), "_doc", "left").select(*docs.columns, "_list")
    at, length = docs.columns.index(text_col), docs.columns.index(length_col) if length_col in docs.columns else None

    @lean
    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                texts = [t if t is None or not p else kept_bytes(t.encode(), p)[0].decode("utf-8", "ignore") for t, p in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True)]
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                stays = pa.array([bool(t) or not before for t, before in zip(texts, columns[at].to_pylist(), strict=True)], pa.bool_())
                columns[at] = pa.array(texts, columns[at].type)
                if length is not None:
                    columns[length] = pa.array([n if t == before else len(t) for t, before, n in zip(texts, part.column(at).to_pylist(), columns[length].to_pylist(), strict=True)], columns[length].type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:-1]).filter(stays)

    return joined.transform(in_arrow, run, docs.schema)
