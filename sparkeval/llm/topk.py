"""Exact top-k search by inner product with MaxScore.

Vectors lie in blocks, kept by dimension: one posting list of weights for each term, which stay where they are; blocks of queries come to them.
For a query, a term's bound is the most it can add within the block above the least it must add. Terms are split by cumulated bounds
against the query's running threshold, a k-th best score found so far: the terms whose bounds together cannot lift a vector over it are
non-essential. The essential postings of a block of queries are traversed first; vectors that are still competitive are probed in the
non-essential terms, in the order of the bounds, and leave as soon as what is left cannot lift them over the threshold. The first blocks give
each query the threshold that it carries to all others. Every block returns its own k best, which a window merges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkeval.llm.common import read, stage

SCALE = 256
BLOCK_VECTORS = 8192
BLOCK_QUERIES = 256
SHARD_BLOCKS = 16  # blocks that a copy of the queries is sent to
SEEDS = 64  # vectors that give a first threshold where there is none yet
WAVE, STEP = 8, 4  # non-essential terms probed at a time: of a block of vectors, and of the few that are left
MANY = 0.1  # the share of a block from which its vectors are probed together


def quantised(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * values.astype(np.float64))


def _matrix(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors as rows, 0 beyond the end of shorter ones."""
    out = np.zeros((len(vectors), max((len(v) for v in vectors), default=0)))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _blocks(size: int):
    """Blocks of quantised vectors by dimension, with their place among the blocks of the task."""

    def block(ids: list[int], held: list[np.ndarray], place: int) -> pa.RecordBatch:
        m = np.ascontiguousarray(_matrix(held).T)
        columns = [pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([len(ids)]), pa.array([place])]
        return pa.RecordBatch.from_arrays(columns, ["ids", "weights", "n", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        held: list[np.ndarray] = []
        place = 0
        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("vector"), strict=True):
                x = quantised(v.values.to_numpy(zero_copy_only=False))
                if not np.isfinite(x).all():
                    continue
                ids.append(i)
                held.append(x)
                if len(ids) >= size:
                    yield block(ids, held, place)
                    ids, held, place = [], [], place + 1
        if ids:
            yield block(ids, held, place)

    return run


class Postings:
    """A block: ids, and for each term its weights over the vectors and their extremes."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        self.ids, self.weights = ids, weights
        self.low, self.high = weights.min(axis=1), weights.max(axis=1)


def best_of(queries: np.ndarray, own: np.ndarray, thresholds: np.ndarray, block: Postings, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (rows; `own` are their ids) places and scores of the block's k best vectors that reach its threshold, by MaxScore."""
    d = min(queries.shape[1], len(block.weights))
    q, weights, ids = queries[:, :d], block.weights[:d], block.ids
    a, b = q * block.low[:d], q * block.high[:d]
    least, bound = np.minimum(a, b), np.abs(b - a)
    floor = least.sum(axis=1)
    thresholds = thresholds.copy()
    if len(ids) > k and np.isneginf(thresholds).any():  # the k-th best of some vectors is at most the k-th best of all
        some = np.unique(np.linspace(0, len(ids) - 1, SEEDS).astype(np.int64))
        seen = np.where(own[:, None] == ids[some], -np.inf, q @ weights[:, some])
        if len(some) >= k:
            thresholds = np.maximum(thresholds, np.partition(seen, len(some) - k, axis=1)[:, len(some) - k])
    order = np.argsort(-bound, axis=1, kind="stable")
    falling = np.take_along_axis(bound, order, axis=1)
    rest = np.hstack([np.cumsum(falling[:, ::-1], axis=1)[:, ::-1], np.zeros((len(q), 1))])  # what the terms from a place on can add
    # essential: all before the first place from which the rest cannot reach the threshold
    n_essential = np.maximum((rest >= (thresholds - floor)[:, None]).sum(axis=1), 1).clip(max=d)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(d)[None, :], axis=1)
    place -= n_essential[:, None]  # below 0: essential
    rows, others = np.arange(len(q)), own[:, None] != ids
    partial = np.where(place < 0, q, 0.0) @ weights  # the traversal of the essential postings
    done = 0
    while True:  # the first probes, while many vectors are competitive: all of a block at once
        open_floor = np.where(place >= done, least, 0.0).sum(axis=1)
        left = rest[rows, np.minimum(n_essential + done, d)]
        if len(ids) > k:  # what is sure of the k best so far raises the threshold
            sure = np.partition(np.where(others, partial, -np.inf), len(ids) - k, axis=1)[:, len(ids) - k]
            thresholds = np.maximum(thresholds, sure + open_floor)
        alive = others & (partial >= (thresholds - open_floor - left)[:, None])
        if alive.mean() < MANY or not (place >= done).any():
            break
        partial += np.where((place >= done) & (place < done + WAVE), q, 0.0) @ weights
        done += WAVE
    for i in range(len(q)):
        some = np.flatnonzero(alive[i])
        score, threshold, ahead = partial[i, some], thresholds[i], open_floor[i]
        for at in range(n_essential[i] + done, d, STEP):
            terms = order[i, at : at + STEP]
            score = score + q[i, terms] @ weights[terms[:, None], some]
            ahead -= least[i, terms].sum()
            if len(some) > k:
                threshold = max(threshold, np.partition(score, len(score) - k)[len(score) - k] + ahead)
            keep = score + ahead + rest[i, min(at + STEP, d)] >= threshold
            some, score = some[keep], score[keep]
        first = np.lexsort((ids[some], -score))[:k]
        yield i, some[first], score[first]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in ("block", "ids", "weights", "n", "query_ids", "queries", "thresholds")}
                if row["block"].as_py() != last:  # rows of a block come one after the other
                    last = row["block"].as_py()
                    ids = np.frombuffer(row["ids"].as_buffer(), np.int64)
                    block = Postings(ids, np.frombuffer(row["weights"].as_buffer(), np.float64).reshape(-1, len(ids)))
                own = np.array(row["query_ids"].as_py(), np.int64)
                queries = _matrix([quantised(np.array(x, np.float64)) for x in row["queries"].as_py()])
                out: list[tuple] = []
                for i, places, scores in best_of(queries, own, np.array(row["thresholds"].as_py(), np.float64), block, k):
                    out += [(int(own[i]), int(ids[p]), int(s)) for p, s in zip(places, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], ["query_id", "id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), id and score: each query's k best of all vectors but those with its own id.

    Components are floor(256 x); scores are integer inner products, exact up to 2^53, shorter vectors counting as 0 beyond their end; ties go to
    the smaller id. Vectors or ids that are null, and vectors with null or non-finite components (times 256), take no part on either side.
    Repeated rows are candidates of their own: n rows of an id take n ranks, and a query id with n rows meets each candidate n times.
    Fewer candidates than k give fewer rows; other columns are not looked at. The work is queries times vectors; the
    shuffle holds the vectors once and the queries once for every SHARD_BLOCKS blocks, and a block's weights go to Python once for every pack of queries.
    """
    ok = F.col("vector").isNotNull() & F.col("id").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * SCALE) == float("inf")))
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    blocks = pick(vectors).where(ok).mapInArrow(_blocks(block_vectors), "ids binary, weights binary, n long, place long")
    blocks = stage(blocks.withColumn("block", F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("place")).drop("place"), "topk_blocks")
    n_blocks = blocks.count()
    shards = max(1, -(-n_blocks // SHARD_BLOCKS))
    blocks = blocks.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int"))
    asked = stage(pick(queries).where(ok).withColumn("query", F.monotonically_increasing_id()), "topk_queries")
    groups = max(1, -(-asked.count() // block_queries))

    def against(some: DataFrame, thresholds: DataFrame | None, copies: int) -> DataFrame:
        own = asked if thresholds is None else asked.join(thresholds, "id", "left")
        threshold = F.lit(float("-inf")) if thresholds is None else F.coalesce("threshold", F.lit(float("-inf")))
        packs = own.groupBy(F.pmod(F.xxhash64("query"), F.lit(groups)).alias("group")).agg(F.collect_list(F.struct("id", "vector", threshold.alias("threshold"))).alias("q"))
        packs = packs.select(F.col("q.id").alias("query_ids"), F.col("q.vector").alias("queries"), F.col("q.threshold").alias("thresholds"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("shard"))
        return some.join(packs.hint("merge"), "shard").mapInArrow(_search(k), "query_id long, id long, score long")

    least = blocks.agg(F.min("block")).first()[0]
    if least is None:
        return asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0).cast("long").alias("score")).where("false")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    seeds = stage(against(blocks.where(F.col("block") == least).withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(1)).cast("int")), None, 1), "topk_seeds")
    # a query id with several rows finds each candidate as often; its threshold is the k-th best of one of them
    rows = asked.groupBy("id").agg(F.count("*").alias("times"))
    placed = seeds.withColumn("place", F.row_number().over(by_score)).join(rows, seeds["query_id"] == rows["id"]).where(F.col("place") == k * F.col("times"))
    thresholds = placed.select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("threshold"))
    found = against(blocks.where(F.col("block") != least), thresholds, shards).unionByName(seeds)
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op8_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    out = top_k(vectors, vectors.where("vec_id % 50 = 0"))
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
