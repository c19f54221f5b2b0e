"""Helpers shared by the corpus operators: text cutting, word hashes, stored steps.

Two cuts of a text are used everywhere. A *word* is a run of digits, letters or non-ASCII characters
with A-Z lowered; a *chunk* is a run of anything but ASCII white space. Both work on UTF-8 bytes,
where they are one table translation and one split.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)


def words(data: bytes) -> list[bytes]:
    """Lower-cased words of UTF-8 text."""
    return data.translate(_WORDS).split()


class Memo(dict):
    """A dictionary that computes what it lacks and starts anew when it has grown to its bound.

    The bound limits memory only; a value is the same whenever it is computed.
    """

    def __init__(self, compute, bound: int = 1_000_000):
        super().__init__()
        self.compute, self.bound = compute, bound

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) >= self.bound:
            self.clear()
        self[key] = value
        return value


def word_hashes(bound: int = 250_000) -> Memo:
    return Memo(xxhash.xxh3_64_intdigest, bound)


def hashes(items: list[bytes], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, items), np.uint64, len(items))


_ODD = tuple(np.uint64(2 * k * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF | 1) for k in range(64))


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value of each 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(word_hash: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `width` words; a shorter text is one run, no words none."""
    n = len(word_hash)
    if not n:
        return word_hash
    k = min(width, n)
    total = word_hash[: n - k + 1] * _ODD[0]
    for i in range(1, k):
        total = total + word_hash[i : n - k + 1 + i] * _ODD[i]
    return np.unique(mix(total))


# rows of one Arrow batch: whole documents, of which ten thousand (the default) may be too much for a task
ARROW_ROWS = 1_000


def whole(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id and the whole text, null read as empty; other columns only when named.

    Sets the session's Arrow batches to at most `ARROW_ROWS` rows.
    """
    conf = docs.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *extra)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def _release() -> None:
    """Gives freed memory back to the machine: the worker process lives on and is used again."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def batches(records: Iterator[pa.RecordBatch], step: int = 1_000, *caches) -> Iterator[pa.RecordBatch]:
    """Record batches of at most `step` rows, so what a task holds besides is small.

    The task's caches are cleared behind its last batch: what they still hold could not be given back.
    """
    for batch in records:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
    for cache in caches:
        cache.clear()
    _release()


def held_out(of: int, remainder: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of == remainder


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one all machines share; the warehouse's where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/steps/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes a step where every machine finds it again and reads it back: lost executors cost nothing."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def wide(df: DataFrame) -> int:
    """Shuffle partitions of the session, for explicit repartitioning."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
