"""Token ids in bit-packed binary files: each id takes the fewest bits that hold every id of the vocabulary.

A file is a run of segments, each followed by one line feed. A segment holds whole documents in ascending order of their ids:

    magic, 8 bytes | length of the rest, u64 | width u32 | ids in a block u32 | documents u64 | ids u64 | task u64 | ids of the task before u64
    document ids, i64 each | 1 where the document id is null, u8 each | ends of the documents' ids, u64 each
    byte offsets of the blocks and of their end, u64 each | blocks: ids of ``width`` bits, highest bit first, the last byte filled up

All numbers are little-endian. Blocks begin at whole bytes, so any of them is unpacked by itself: reading some ids of a long
document touches the blocks that cover them. Tasks are numbered in ascending order of document ids, so the ids before a
segment are those of earlier tasks and those that the segment names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir, small, stored
from .arrow import in_arrow, lean, slices
from .packing import SLICE, encoder

MAGIC, HEAD = b"TOKBITS1", struct.Struct("<8sQIIQQQQ")
#: Ids in a block (a multiple of 8) and, unless one document has more, in a segment; segments in a file.
BLOCK, SEGMENT, PER_FILE = 4096, 1 << 20, 16


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as ``width`` bits each, highest bit first; the last byte is filled up with zeros."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"id {ids.max()} needs more than {width} bits")
    raw = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    if width % 8 == 0:
        return raw[:, 4 - width // 8 :].tobytes()
    return np.packbits(np.unpackbits(raw, axis=1)[:, 32 - width :].ravel()).tobytes()


def unpack(raw, count: int, width: int) -> np.ndarray:
    """The first ``count`` ids of packed bytes."""
    data = np.frombuffer(raw, np.uint8)
    out = np.zeros((count, 4), np.uint8)
    if width % 8 == 0:
        out[:, 4 - width // 8 :] = data[: count * width // 8].reshape(count, width // 8)
    else:
        bits = np.zeros((count, 32), np.uint8)
        bits[:, 32 - width :] = np.unpackbits(data, count=count * width).reshape(count, width)
        out = np.packbits(bits, axis=1)
    return out.reshape(-1).view(">u4").astype(np.uint32)


def segment(docs: list[int | None], ids: list[np.ndarray], width: int, task: int, before: int) -> bytes:
    flat = np.concatenate(ids)
    blocks = [pack(flat[i : i + BLOCK], width) for i in range(0, len(flat), BLOCK)]
    own = np.array([d or 0 for d in docs], "<i8"), np.array([d is None for d in docs], np.uint8), np.cumsum([len(x) for x in ids]).astype("<u8")
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    rest = b"".join([*(x.tobytes() for x in own), offsets.tobytes(), *blocks])
    return HEAD.pack(MAGIC, HEAD.size - 16 + len(rest), width, BLOCK, len(docs), len(flat), task, before) + rest


class Segment:
    """A segment in a buffer; ids are unpacked when asked for."""

    def __init__(self, raw: memoryview, at: int):
        magic, size, self.width, self.block, n, self.n_ids, self.task, self.before = HEAD.unpack_from(raw, at)
        if magic != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        self.end = at + 16 + size
        at += HEAD.size
        self.docs = np.frombuffer(raw, "<i8", n, at)
        self.null = np.frombuffer(raw, np.uint8, n, at + 8 * n).astype(bool)
        self.ends = np.frombuffer(raw, "<u8", n, at + 9 * n).astype(np.int64)
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1, at + 17 * n).astype(np.int64)
        self.data = raw[at + 17 * n + 8 * (blocks + 1) : self.end]

    def ids(self, first: int, last: int) -> np.ndarray:
        """The segment's ids from ``first`` to before ``last``; only the blocks that hold them are unpacked."""
        if first >= last:
            return np.zeros(0, np.uint32)
        i, j = first // self.block, -(-last // self.block)
        if self.block * self.width % 8 == 0:  # then whole blocks join without a gap
            some = unpack(self.data[self.offsets[i] : self.offsets[j]], min(j * self.block, self.n_ids) - i * self.block, self.width)
        else:
            some = np.concatenate([unpack(self.data[self.offsets[k] : self.offsets[k + 1]], min(self.block, self.n_ids - k * self.block), self.width) for k in range(i, j)])
        return some[first - i * self.block : last - i * self.block]


def segments(raw) -> Iterator[Segment]:
    view, at = memoryview(raw), 0
    while at < len(view):
        s = Segment(view, at)
        yield s
        at = s.end + 1


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Encode all texts, append ``end_id`` to each, and write token files to ``path``; returns the bits of an id.

    Documents stand in ascending order of their ids, null ids first, rows of equal ids by a hash of their text. A null or
    empty text is ``end_id`` alone, no rows give no segments, and other columns are not read. Texts are shuffled once, by
    ranges of ids and hashes, so that a repeated id doesn't fill one task, and encoded where they are written.
    """
    from tokenizers import Tokenizer

    width = max(1, (max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id)).bit_length())

    @lean
    def cut(batches):
        from pyspark import TaskContext

        e, end, task, before, own, ids, held = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0, [], [], 0

        def whole():
            return pa.RecordBatch.from_arrays([pa.array([segment(own, ids, width, task, before)], pa.binary())], names=["segment"])

        for batch in batches:
            for part in slices(batch, 1, SLICE):
                for doc, raw in zip(part.column(0).to_pylist(), e.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    one = np.frombuffer(raw + end, "<u4")
                    if own and held + len(one) > SEGMENT:
                        yield whole()
                        before, own, ids, held = before + held, [], [], 0
                    own.append(doc)
                    ids.append(one)
                    held += len(one)
        if own:
            yield whole()

    text = F.col(text_col).cast("string")
    some = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))
    ordered = some.repartitionByRange("doc", "tie").sortWithinPartitions("doc", "tie").select("doc", "text")
    # the text writer puts a row's bytes into the file as they are, and a line feed after each
    in_arrow(ordered, cut, "segment binary").select(F.col("segment").cast("string")).write.option("maxRecordsPerFile", PER_FILE).text(path)
    return width


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id", keep: bool = True, first: int = 0, last: int | None = None) -> DataFrame:
    """Read token files back, a row a document.

    Returns the id, start (ids of all documents before it), n_tokens, ids_crc32 (of all its ids as little-endian unsigned
    32-bit integers) and ids, an array of the ids ``first`` to before ``last`` (null unless ``keep``). With ``last`` set, only
    the blocks that hold those ids are unpacked, and ids_crc32 is that of those ids.
    """
    schema = f"{id_col} long, task long, own long, n_tokens long, ids_crc32 long, ids array<long>"

    @lean
    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                for s in segments(raw.as_buffer()):
                    starts = np.concatenate([[0], s.ends[:-1]])
                    if last is None and not first:
                        flat = s.ids(0, s.n_ids)
                        parts = [flat[i:j] for i, j in zip(starts, s.ends, strict=True)]
                    else:
                        parts = [s.ids(min(i + first, j), j if last is None else max(min(i + first, j), min(i + last, j))) for i, j in zip(starts.tolist(), s.ends.tolist(), strict=True)]
                    n = len(s.docs)
                    ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts).astype(np.int64))) if keep else pa.nulls(n, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(s.docs, mask=s.null), pa.array(np.full(n, s.task, np.int64)), pa.array(s.before + starts.astype(np.int64)), pa.array(s.ends - starts), pa.array([zlib.crc32(x.astype("<u4")) for x in parts], pa.int64()), ids], names=[c.split()[0] for c in schema.split(", ")])

    rows = spark.read.format("binaryFile").load(path).select("content").transform(in_arrow, run, schema)
    if not keep:
        rows = stored(rows, "index")
    # at most a row a task of the writing job
    tasks = rows.groupBy("task").agg(F.max(F.col("own") + F.col("n_tokens")).alias("ids"))
    base = tasks.select("task", F.coalesce(F.sum("ids").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(small(base), "task").select(id_col, (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32", "ids")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """``write_tokens`` to a new folder in the shared one, and ``read_tokens`` from it."""
    path = f"{shared_dir(docs.sparkSession)}/gazeflow/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id, id_col, text_col)
    return read_tokens(docs.sparkSession, path, id_col, keep)
