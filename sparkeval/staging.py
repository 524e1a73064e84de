"""Tables between jobs, in the folder that driver and executors share, and rows numbered over a global order."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-stage-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode with none set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_folder()


def _delete(jvm, conf, folder: str) -> None:
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(conf).delete(path, True)


@cache
def _run_folder(folder: str, application: str) -> str:
    """The folder of one application's tables, deleted when its driver ends."""
    own = f"{folder}/stages-{application}"
    spark = SparkSession.active()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def clear() -> None:
        try:
            _delete(jvm, conf, own)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            pass

    atexit.register(clear)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted with the application's tables."""
    return f"{_run_folder(shared_folder(spark), spark.sparkContext.applicationId)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: computed once, its lineage cut, safe when executors go."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(spark._jvm, spark._jsc.hadoopConfiguration(), folder)


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left joined with right on equal keys, nulls being equal too; the keys stay once."""
    r = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(r, on, how).drop(*[f"__{k}" for k in keys])


#: A side of at most so many bytes is broadcast; a larger one is joined by shuffles.
BROADCAST_BYTES = 32 << 20
#: Rows that a range of an order should have.
RANGE_ROWS = 1_000_000


def small(df: DataFrame, rows: int, width: int = 128) -> DataFrame:
    """Broadcast df if its counted rows of about `width` bytes are within the bound; beyond it Spark joins by shuffles and splits skewed keys."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def checked(df: DataFrame, name: str, width: int = 128) -> DataFrame:
    """df as a staged table, broadcast if its counted rows are within the bound."""
    s = stage(df, name)
    return small(s, s.count(), width)


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str, parts: int | None = None) -> DataFrame:
    """df as a staged table with `part`: ranges of keys and order, so that a key with many rows has many parts; equal rows share one.

    Parts rise with the order within a key. Without `parts` there are as many as shuffle partitions.
    """
    dealt = df.repartitionByRange(parts, *keys, *order) if parts else df.repartitionByRange(*keys, *order)
    return stage(dealt.withColumn("part", F.spark_partition_id()), name)


def _counts(b: pa.RecordBatch, column: str) -> np.ndarray:
    return b.column(column).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def _differs(a: pa.Array) -> np.ndarray:
    """Whether each row but the first differs from the one before it; nulls are equal, and so are NaNs."""
    x, y = a.slice(1), a.slice(0, len(a) - 1)
    other = pc.fill_null(pc.not_equal(x, y), False)
    if pa.types.is_floating(a.type):
        other = pc.and_not(other, pc.fill_null(pc.and_(pc.is_nan(x), pc.is_nan(y)), False))
    return pc.or_(other, pc.xor(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False)


def merged(batches: Iterable[pa.RecordBatch], keys: Sequence[str], columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows of equal keys, which follow each other, as one with the sums of the columns."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        b = b if last is None else pa.concat_batches([last, b])
        new = np.ones(b.num_rows, bool)
        new[1:] = np.any([_differs(b.column(k)) for k in keys], axis=0)
        at = np.flatnonzero(new)
        out = b.take(pa.array(at))
        for c in columns:
            out = out.set_column(out.schema.get_field_index(c), b.schema.field(c), pa.array(np.add.reduceat(_counts(b, c), at)))
        yield out.slice(0, len(at) - 1)
        last = out.slice(len(at) - 1)
    if last is not None:
        yield last


def running(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), more: Sequence[str] = ()) -> DataFrame:
    """df with `x_run` for each of the columns: its sum over a partition's rows up to this one, in the order that they have; nulls count as 0.

    With keys, rows of equal ones that follow each other become one, with the sums of columns and more.
    """

    def add(batches):
        before = dict.fromkeys(columns, 0)
        for b in merged(batches, keys, [*columns, *more]) if keys else batches:
            for c in columns:
                sums = np.cumsum(_counts(b, c)) + before[c]
                before[c] = sums[-1] if len(sums) else before[c]
                b = b.append_column(f"{c}_run", pa.array(sums))
            yield b

    return df.mapInArrow(add, reduce(lambda t, c: t.add(f"{c}_run", LongType()), columns, StructType(list(df.schema))))


def before_parts(parted: DataFrame, keys: Sequence[str], sums: dict[str, Column], also: dict[str, Column] | None = None) -> DataFrame:
    """keys, part, and for each sum its total over the key (`x_all`) and over the parts before (`x_before`): a row for each part and key, with other aggregates if asked."""
    also = also or {}
    per = parted.groupBy(*keys, "part").agg(*[v.alias(k) for k, v in {**sums, **also}.items()])
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = [F.sum(k).over(whole).cast("long").alias(f"{k}_all") for k in sums]
    return per.select(*keys, "part", *also, *totals, *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).cast("long").alias(f"{k}_before") for k in sums])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str, number: str = "place") -> DataFrame:
    """df with the number of each row, from 0, within its keys; only a part's rows are sorted together, about RANGE_ROWS however many df has."""
    r = ranged(df, keys, order, name, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // RANGE_ROWS + 1))
    first = before_parts(r, keys, {"rows": F.count("*")}).drop("rows_all")
    inside = Window.partitionBy(*keys, "part").orderBy(*order)
    out = same_keys(r, checked(first, f"{name}_before"), [*keys, "part"])  # a row for each part, and one more for each key
    return out.withColumn(number, F.row_number().over(inside) - 1 + F.col("rows_before")).drop("part", "rows_before")
