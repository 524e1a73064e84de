"""MaxScore over many small blocks, with thresholds carried between them, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkeval.llm import topk


def brute(rows, k):
    q = [(i, [int(256 * x // 1) for x in map(float, e)]) for i, e in rows]
    want = []
    for i, a in q:
        if i % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in q if j != i)
            want += [(i, j, -s) for s, j in scored]
    out = {}
    for i, j, s in want:
        out.setdefault(i, []).append((-s, j))
    return {(i, n + 1, j, -s) for i, found in out.items() for n, (s, j) in enumerate(sorted(found)[:k])}


@pytest.mark.parametrize("k, block", [(5, 8), (1, 3), (40, 16)])
def test_many_blocks(spark, k, block):
    rng = np.random.default_rng(k)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 1, 6)]) for i in range(210)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("block", F.lit("x"))
    got = topk.top_k(v.repartition(4), v.where("vec_id % 50 = 0"), k, block_vectors=block, block_queries=2)
    assert {tuple(r) for r in got.collect()} == brute(rows, k)


def test_repeated_over_blocks(spark):
    rows = [(0, [1.0, 1.0])] * 9 + [(1, [0.9, 0.9])] * 3 + [(i, [0.5, i / 128]) for i in range(2, 12)] + [(50, [-1.0, 0.25])] * 2
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    q = [(i, [int(256 * x // 1) for x in map(float, e)]) for i, e in rows]
    want = []
    for i in (0, 50):
        scored = sorted((-sum(x * y for x, y in zip(a, b)), j) for n, a in q if n == i for j, b in q if j != i)
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:5])]
    got = topk.top_k(v, v.where("vec_id % 50 = 0"), 5, block_vectors=4, block_queries=3)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_kernel_splits_terms():
    """Some terms are non-essential under the threshold, and the best are found all the same."""
    rng = np.random.default_rng(2)
    weights = np.floor(rng.normal(0, 30, (16, 3000))) * np.linspace(2, 0.1, 16)[:, None] // 1
    queries, ids = np.floor(rng.normal(0, 30, (4, 16))), np.arange(3000)
    full = queries @ weights
    best = np.sort(full, axis=1)[:, -3]
    found = list(topk.best_of(queries, np.full(4, -1), best, topk.Postings(ids, weights), 3))
    for i, places, scores in found:
        assert list(scores) == sorted(full[i], reverse=True)[:3] and list(places) == sorted(ids, key=lambda j: (-full[i, j], j))[:3]  # noqa: B023
