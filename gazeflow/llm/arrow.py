"""Arrow-batch helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..session import in_arrow as in_arrow

#: Texts are handled in slices of about this many bytes, so a batch of very long documents stays small in memory.
SLICE_BYTES = 8 << 20
#: Freed memory goes back to the system after so many bytes of input.
TRIM_BYTES = 16 << 20
#: Thresholds of glibc's allocator: temporary arrays up to 32 MB come from memory that is kept until 64 MB of it are free.
MMAP_THRESHOLD, TRIM_THRESHOLD = (-3, 32 << 20), (-1, 64 << 20)


def libc(name: str, *values: int) -> None:
    """Call a function of glibc's allocator; other C libraries lack it and go without."""
    f = getattr(ctypes.CDLL(None), name, None)
    if f is not None:
        f(*values)


def give_back() -> None:
    """Return freed memory to the system, which the allocators would keep for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    libc("malloc_trim", 0)


def lean(run: Callable) -> Callable:
    """``run``, a function for ``mapInArrow``, in a worker that gives back what it freed from time to time and at the end.

    Spark keeps workers for later stages; without this, idle ones hold the most that any task of theirs ever used.
    """

    @functools.wraps(run)
    def wrapped(batches):
        def fed():
            read = 0
            for batch in batches:
                read += batch.nbytes
                if read > TRIM_BYTES:
                    give_back()
                    read = 0
                yield batch
                del batch

        libc("mallopt", *MMAP_THRESHOLD)
        libc("mallopt", *TRIM_THRESHOLD)
        yield from run(fed())
        give_back()

    return wrapped


def slices(batch: pa.RecordBatch, column: int | None = None, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose buffers hold about ``limit`` bytes; a single longer row is a run of its own."""
    if batch.num_rows <= 1 or batch.nbytes <= limit:
        yield batch
        return
    if column is None:
        step = max(1, batch.num_rows * limit // max(1, batch.nbytes))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], schema: str, text: int | None = None) -> DataFrame:
    """``mapInArrow`` where ``make()`` is called once per task and gives a function from a slice to a list of columns."""
    names = [c.split()[0] for c in schema.split(",")]

    @lean
    def run(batches):
        f = make()
        for batch in batches:
            for part in slices(batch, text):
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays(f(part), names=names)

    return df.transform(in_arrow, run, schema)


def grouped(batches, keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Groups of equal values of the first ``keys`` columns, whose rows stand together; meant for groups of bounded size."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None

    def whole() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[start]:
                if key is not None and rows[start] != key:
                    yield key, whole()
                    held = []
                key = rows[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield key, whole()
