"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The C library where it can trim its heap (glibc), else None.
LIBC = next((c for c in [ctypes.CDLL(ctypes.util.find_library("c") or None)] if hasattr(c, "malloc_trim")), None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def give_back() -> None:
    """Return the memory that a Python worker has freed to the system; workers outlive tasks and stages, and would keep it."""
    pa.default_memory_pool().release_unused()
    if LIBC is not None:
        LIBC.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 24 << 20, rows: int = 4096, lean: bool = False) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most about `limit` bytes of `column` (one row at least), to bound memory. lean: what the worker has freed goes back to the system before and after."""
    if lean:
        give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (total + n > limit or i - start >= rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)
    if lean:
        give_back()


def held_out(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo `mod`, is 0. A null id counts as an empty text (crc32 0): held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == 0


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n
