"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised bytes, an external sort inside each partition places equal texts side by side,
and neighbours are compared in full. The sort key abbreviates the bytes: their first characters, a hash of the rest of
them, then the id, so that splitters stay short and a large group of copies spreads over several partitions. Only the runs at
partition borders (at most two a partition) are merged afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeval.llm.common import stage, trimmed

PREFIX = 64


def normalised(text: bytes | None) -> bytes:
    """A-Z to lower case, nothing else; null counts as empty."""
    return (text or b"").lower()


def _mark(keep_rows: bool, row_type: pa.DataType | None = None):
    """Neighbour comparison over one sorted partition; holds the ids of one run of equal sort keys at a time."""
    names = ["id", "key", "keep_id", "n", "last", "open", "part"] + ["row"] * keep_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        state: dict[bytes, list] = {}  # of the current run: normalised text -> ids, and the last row
        at, first = None, True

        def rows(is_open: bool):
            for text, (ids, last) in state.items():
                key = hashlib.sha256(text).digest()
                for i in range(len(ids) - 1 if keep_rows else 0, len(ids)):
                    yield (ids[i], key, ids[-1], len(ids), i == len(ids) - 1, is_open, part, last)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            ids, keys, keeps, ns, lasts, opens, parts, held = zip(*out, strict=True)
            columns = [
                pa.array(ids, pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array(keeps, pa.int64()),
                pa.array(ns, pa.int64()),
                pa.array(lasts, pa.bool_()),
                pa.array(opens, pa.bool_()),
                pa.array(parts, pa.int32()),
            ]
            if keep_rows:
                columns.append(pa.concat_arrays(held))
            return pa.RecordBatch.from_arrays(columns, names)

        out: list[tuple] = []
        for batch in batches:
            ids, digests = batch.column("id").to_pylist(), batch.column("digest").to_pylist()
            prefixes, texts = batch.column("prefix"), batch.column("text").cast(pa.binary())
            kept_rows = batch.column("row") if keep_rows else None
            for i, digest in enumerate(digests):
                here = (digest, prefixes[i].as_py())
                if here != at:
                    if at is not None:
                        out.extend(rows(first))
                        first = False
                    state, at = {}, here
                mine = state.setdefault(normalised(texts[i].as_py()), [[], None])
                mine[0].append(ids[i])
                if keep_rows:
                    mine[1] = kept_rows.slice(i, 1)
            if len(out) > 2000:
                yield batch_of(out)
                out = []
        if at is not None:
            out.extend(rows(True))
        if out:
            yield batch_of(out)

    return run


def mark_copies(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> DataFrame:
    """Group documents whose texts are equal after lower-casing A-Z.

    Returns id, key (SHA-256 of the normalised text), keep_id, n (size of the group) and kept, one row per input row. With
    `rows`, only the kept rows, each with its whole input row as struct `row`. `keep` is "smallest" or "largest" id.
    Null and empty texts are equal. A null id stays only if its group has no other; of repeated rows with the id that
    stays, exactly one is kept. An empty table gives an empty result; other columns are not looked at.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep}")
    lowered = F.lower(F.coalesce(F.col(text_col), F.lit("")))  # folds at least what normalised() folds
    source = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
        F.substring(lowered, 1, PREFIX).alias("prefix"),
        F.xxhash64(lowered).alias("digest"),
        *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * rows,
    )
    order = F.col("id").asc_nulls_first() if keep == "largest" else F.col("id").desc_nulls_first()
    schema = "id long, key binary, keep_id long, n long, last boolean, open boolean, part int"
    if rows:
        schema += f", row {source.schema['row'].dataType.simpleString()}"
    found = stage(
        source.repartitionByRange("prefix", "digest", order)
        .sortWithinPartitions("prefix", "digest", order)
        .mapInArrow(trimmed(_mark(rows)), schema),
        "content_sort",
    )
    best = (F.max if keep == "largest" else F.min)("keep_id")
    # min_by and min skip nulls only at the top level: a struct with a null id must lose
    weight = F.struct(F.col("keep_id").isNotNull() if keep == "largest" else F.col("keep_id").isNull(), F.col("keep_id"), F.col("part"))
    part = (F.max_by if keep == "largest" else F.min_by)(F.col("part"), weight)
    border = (
        found.where("open and last")
        .groupBy("key")
        .agg(best.alias("all_keep"), F.sum("n").alias("all_n"), part.alias("all_part"))
        .withColumn("open", F.lit(True))
    )
    # bound: two runs for each partition of the range sort
    merged = found.join(F.broadcast(border), ["key", "open"], "left")
    kept = F.col("last") & (~F.col("open") | (F.col("part") == F.col("all_part")))
    merged = merged.select(
        "id",
        "key",
        F.when(F.col("open"), F.col("all_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("all_n", "n").alias("n"),
        kept.alias("kept"),
        *["row"] * rows,
    )
    return merged.where("kept") if rows else merged


def exact_dedup(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with docs' columns."""
    out = mark_copies(docs, keep, id_col, text_col, rows=True)
    return out.select("row.*")


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from sparkeval.llm.common import read

    marked = mark_copies(read(spark, sf_dir, "documents"), keep="largest")
    return marked.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        F.col("n").alias("group_size"),
        "kept",
        F.lower(F.hex("key")).alias("text_sha256"),
    )


OP10_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT *, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept FROM t WINDOW w AS (PARTITION BY body))
SELECT doc_id, keep_id, group_size, kept, sha256(body) AS text_sha256 FROM g
"""
