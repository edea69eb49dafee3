"""WARC archives: one gzip member per record, written with revisit records for repeated payloads and read sequentially."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .arrow import in_arrow

#: An archive is closed once it holds so many compressed bytes; a record is never split.
ARCHIVE_BYTES = 4 << 20
#: Bytes fed to the decompressor at once.
FEED = 1 << 16
#: Parts that the rows of one digest are dealt to in the search for its first page.
SALTS = 64
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(fields: dict[str, str], block: bytes) -> bytes:
    """A WARC record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"WARC-Block-Digest: sha1:{digest(block)}\r\nContent-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit that keeps the HTTP head only, of a page."""
    target = "".join(c for c in url or "about:blank" if c.isprintable() and c != " ") or "about:blank"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = "none" if page_id is None else str(page_id)
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {target}')}>", "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": target, "X-Page-Id": name, "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha1:{digest(payload)}"}
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "X-Refers-To-Page-Id": str(refers_to)}
    return record(fields, http + (payload if refers_to is None else b""))


class Inflater:
    """Plain bytes of a stream of gzip members, decompressed as they are asked for."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.rest, self.plain, self.z = chunks, b"", bytearray(), zlib.decompressobj(31)

    def more(self) -> bool:
        """Decompress one more piece of the current member; False at its end or the input's."""
        if self.z.eof:
            return False
        if not self.rest and not (piece := next(self.chunks, b"")):
            if self.plain:
                raise ValueError("the archive ends inside a record")
            return False
        elif not self.rest:
            self.rest = piece
        self.plain += self.z.decompress(self.rest, FEED)
        self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def next_member(self) -> None:
        self.z = zlib.decompressobj(31)

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the input."""
        at = 0
        while (found := self.plain.find(mark, at)) < 0:
            at = max(0, len(self.plain) - len(mark))
            if not self.more():
                if self.plain:
                    raise ValueError("a record without a head")
                return None
        return self.take(found + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.plain) < n and self.more():
            pass
        if len(self.plain) < n:
            raise ValueError("a record is shorter than its Content-Length")
        out = bytes(self.plain[:n])
        del self.plain[:n]
        return out


def read_records(chunks: Iterator[bytes], verify: bool = True) -> Iterator[tuple[dict[str, str], bytes]]:
    """Heads and blocks of an archive in turn, one gzip member each; wrong framing or digests raise ValueError."""
    stream = Inflater(iter(chunks))
    while (head := stream.until(b"\r\n\r\n")) is not None:
        version, *lines = head.decode().rstrip("\r\n").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = stream.take(int(fields["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its Content-Length says")
        while stream.more():
            pass
        if stream.plain:
            raise ValueError("more than one record in a gzip member")
        if verify and fields.get("warc-block-digest") not in (None, f"sha1:{digest(block)}"):
            raise ValueError("a block does not match its digest")
        if verify and fields.get("warc-type") == "response" and fields.get("warc-payload-digest") not in (None, f"sha1:{digest(block.partition(b'\r\n\r\n')[2])}"):
            raise ValueError("a payload does not match its digest")
        yield fields, block
        stream.next_member()


def first_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``first_id``: for a page whose payload (of at least ``min_bytes``) a page with a smaller id also has, the smallest such id.

    Only digests that repeat are joined, and each of them is dealt to ``SALTS`` parts.
    """
    keyed = pages.withColumn("_sha", F.when(F.length("_payload") >= min_bytes, F.sha1("_payload"))).withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    repeats = keyed.where("_sha is not null").groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null")
    salted = repeats.select("_sha", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return keyed.join(salted, ["_sha", "_salt"], "left").withColumn("first_id", F.when(F.col("page_id").isNull() | (F.col("_first") < F.col("page_id")), F.col("_first"))).drop("_sha", "_salt", "_first")


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives of all pages as rows (archive string, content binary), written to the shared folder.

    ``pages`` has page_id, url and html; other columns are not read. A null html is an empty payload and a null url
    about:blank. Of pages with equal payloads that with the smallest id is the response; a page without an id comes last.
    """
    rows = first_pages(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("_payload")), min_bytes).select("page_id", "url", "_payload", "first_id")

    def pack(batches):
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for page_id, url, payload, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(page_record(page_id, url, payload, first))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{n:06d}.warc.gz"]), pa.array([b"".join(held)])], names=["archive", "content"])
                    n, held, size = n + 1, [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{n:06d}.warc.gz"]), pa.array([b"".join(held)])], names=["archive", "content"])

    return stored(rows.transform(in_arrow, pack, "archive string, content binary"), "warc", "none")


def read_archives(archives: DataFrame, keep: bool = True) -> DataFrame:
    """Records of archives given as rows (archive, content), as ``write_archives`` or Spark's ``binaryFile`` source have them.

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits and unless ``keep``).
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def unpack(batches):
        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

        rows, size = [], 0
        for batch in batches:
            for content in batch.column(0):
                view = memoryview(content.as_buffer())
                for f, block in read_records(bytes(view[i : i + FEED]) for i in range(0, len(view), FEED)):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    length = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    number = lambda k, f=f: int(v) if (v := f.get(k, "none")) != "none" else None
                    rows.append((number("x-page-id"), f.get("warc-target-uri"), length, f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"], number("x-refers-to-page-id"), payload if keep and f["warc-type"] == "response" else None))
                    size += len(payload) if keep else 0
                    if len(rows) >= 5000 or size > 16 << 20:
                        yield made(rows)
                        rows, size = [], 0
        if rows:
            yield made(rows)

    return archives.select("content").transform(in_arrow, unpack, schema)
