"""Shared helpers of the corpus operators: row keys, batches cut by size, hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.store import components, dropped, shared_dir, stored

__all__ = ["BASE", "INV", "TABLE", "bounded_batches", "components", "crc_of_id", "dropped", "keyed", "lean", "mix", "powers", "shared_dir", "slices", "stored", "tables"]


#: Bytes of an Arrow batch on its way to Python, where the session doesn't name another bound.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of this session by bytes, so that buffers outside the heap don't follow the length of texts. A bound that the session sets itself stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def lean(f):
    """f over Arrow batches; when a task ends, what its worker holds but doesn't use goes back to the system, as idle workers stay beside the next stage."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            released()

    return run


def released() -> None:
    """Give back free memory of Arrow's pool and of the C library."""
    import ctypes
    import gc

    tables.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
    if trim:
        trim(0)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and rk, a 64-bit key of both. Rows equal in doc_id and text share rk and are treated as one document."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rk", F.xxhash64("doc_id", "text"))


def crc_of_id() -> F.Column:
    """crc32 of doc_id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of at most rows rows and about limit bytes in column, so that memory doesn't follow the length of texts."""
    col = batch.column(column)
    sizes = np.zeros(len(col), np.int64)
    if len(col):
        off = np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32)
        sizes = np.diff(off[col.offset : col.offset + len(col) + 1].astype(np.int64))
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if i > start and (total + s > limit or i - start >= rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(s)
    if len(sizes) > start:
        yield batch.slice(start)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (in place on a copy)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


#: Powers of one odd base and of its inverse, for rolling hashes over blocks of TABLE bytes at most.
TABLE = 1 << 21
BASE = np.uint64(0x9E3779B97F4A7C15)
INV = np.uint64(pow(int(BASE), -1, 1 << 64))


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i up to TABLE: 32 MB in each worker that hashes texts, built on first use."""
    return powers(TABLE + 1, BASE), powers(TABLE + 1, INV)
