"""What the operators of this subpackage share: staging tables, bounded broadcasts, sorted runs and distributed ranks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkeval.staging import drop_staged, shared_folder, stage

__all__ = ["BROADCAST_BYTES", "blob", "drop_staged", "hash_bucket", "ranked", "read", "release", "runs_of", "shared_folder", "small", "stage", "trimmed"]

#: A side of at most so many bytes is broadcast; a larger one is joined by shuffles.
BROADCAST_BYTES = 32 << 20


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that are over: Spark deletes them once the driver has collected the garbage that refers to them.

    The scheduler holds the last job until another one has run, so that a tiny one comes first.
    """
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int, width: int = 128) -> DataFrame:
    """Broadcast df if its counted rows of about `width` bytes are within the bound; beyond it Spark joins by shuffles and splits skewed keys."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def hash_bucket(column: Column, buckets: int | Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets) if isinstance(buckets, int) else buckets)


def ranked(df: DataFrame, key: str, order: str, rows: int, rank: str = "rank", per_bucket: int = 20_000) -> DataFrame:
    """Number the rows of each key from 0 without gathering a key in one task.

    Rows of a key fall into buckets by the hash of `order`; counts of the buckets give each bucket its first number, and only
    a bucket's rows are sorted together. `rows` is the number of all rows and sets the number of buckets.
    """
    buckets = max(64, rows // per_bucket + 1)
    b = df.withColumn("__bucket", hash_bucket(F.col(order), buckets))
    before = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = b.groupBy(key, "__bucket").agg(F.count("*").alias("__n"))
    first = first.select(key, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy(key, "__bucket").orderBy(F.xxhash64(order), order)
    return (
        b.join(first, [key, "__bucket"])
        .withColumn(rank, F.col("__first") + F.row_number().over(inside) - 1)
        .drop("__bucket", "__first")
    )


def blob(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which a task's Python worker gives back the memory that it holds but no longer uses; workers live on for other tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
            trim(0)

    return whole


def runs_of(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Split batches sorted by `key` into one table for each run of equal keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in key]
        new = np.zeros(batch.num_rows, bool)
        new[0] = last != tuple(c[0] for c in columns)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        last = tuple(c[-1] for c in columns)
        at = 0
        for start in np.flatnonzero(new):
            if start > at:
                held.append(batch.slice(at, start - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], start
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)
