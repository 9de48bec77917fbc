"""Helpers that the operators of this subpackage share: flat byte views, byte-sized chunks, stored tables."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.session import durable_checkpoint

Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_WHITE_SPACE = re.compile(rb"[ \t-\r]")
CHUNK_BYTES = 1 << 21  # bytes of text that one vectorised step takes; a longer text is a chunk of its own


def flat_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets) of an Arrow string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    arr = column.cast(pa.large_binary())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = arr.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0]:offsets[-1]], offsets - offsets[0]


def byte_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges (a, b) of about ``limit`` bytes; every row is in exactly one range."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def text_chunks(texts: Sequence[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` characters."""
    sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    yield from byte_chunks(np.concatenate([[0], np.cumsum(sizes)]), limit)


def word_slices(raw: bytes, limit: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The bytes of a text in slices of about ``limit`` that no word crosses: each ends behind white space, or the text ends."""
    a = 0
    while a < len(raw):
        b = a + limit
        if b < len(raw):
            gap = _WHITE_SPACE.search(raw, b)
            b = gap.end() if gap else len(raw)
        yield raw[a:b]
        a = b


def release_memory() -> None:
    """Hand memory that a task has freed back to the system: workers are used again, by other stages too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim:
        trim(0)


def released(task: Task) -> Task:
    """A task that ends with ``release_memory``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        release_memory()

    return run


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 when divided by 4; a null id counts as learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one named in spark.checkpoint.dir."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        durable_checkpoint(spark.range(0))  # sets the folder where none is named, as in tests
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: cuts lineage, outlives executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


FILTER_BYTES = 1 << 19


def maybe_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key may be among ``ids``: all that are, and few others while ids are few.

    A bit map of fixed size goes to every task, so that rows without a partner are not shuffled for
    the join that follows. With very many ids it lets more through and the join does the work.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(8 * FILTER_BYTES))
    bits = ids.select((bit / 8).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int")).alias("b"))
    held = bits.groupBy("at").agg(F.bit_or("b").alias("b")).toPandas()
    table = np.zeros(FILTER_BYTES, np.uint8)
    table[held["at"].to_numpy()] = held["b"].to_numpy()
    shared = df.sparkSession.sparkContext.broadcast(table)
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            keep = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield batch.select(columns).filter(pa.array(keep.astype(bool)))

    return df.withColumn("_bit", F.coalesce(bit, F.lit(0))).mapInArrow(released(run), df.schema)
