"""Helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tallywork.session import shared_folder

# Text is worked on in pieces of about so many bytes, so that arrays stay small and in cache.
PIECE = 1 << 20


def take(df: DataFrame, **names: str) -> DataFrame:
    """The columns ``names[new]`` under their new names.

    Found by exact name and position, so that other columns may differ from them in case only.
    """
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"c{df.columns.index(old)}").alias(new) for new, old in names.items()])


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it back: a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cells_of(key: Column | str, cells: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(cells))


def only_cells(df: DataFrame, key: str, wanted: DataFrame, cells: int = 1 << 18) -> DataFrame:
    """Drop most rows whose ``key`` is not in ``wanted`` before a join on it has to move them.

    What is broadcast has at most ``cells`` rows of one number, however large ``wanted`` is; rows that
    pass by chance are dropped by the join that follows.
    """
    cell = wanted.select(cells_of(key, cells).alias("_cell")).distinct()
    return df.join(F.broadcast(cell), cells_of(key, cells) == F.col("_cell"), "left_semi")


def pieces(texts: list[bytes], limit: int = PIECE):
    """Index ranges of consecutive texts that hold about ``limit`` bytes together."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 4 * PIECE):
    """Parts of a batch that hold about ``limit`` bytes of text each, so that a batch is never unpacked whole."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        held = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, held + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def trim() -> None:
    """Give freed memory back to the system: Python workers share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def release(spark) -> None:
    """Let Spark remove the shuffle files of frames that a checkpoint or written table has replaced.

    Its cleaner waits for the driver's garbage collection, which a small driver heap may not see for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
