"""Weights of draws: those of any patients are a slice of the whole draw, and the whole draw is a resample."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkeval import bootstrap, draws, ranking
from sparkeval.staging import stage

N = draws.FLAT + 4_321  # more than are hashed at once


def plain(n, draw, seed):
    """Up to FLAT patients: n slots hashed onto them, as the queries' SQL has it."""
    first, second = draws.draw_keys(draw, seed)
    out = np.zeros(n, int)
    for i in range(n):
        h = draws.mixed((draws.mixed(((i * draws.STEP) & draws.MASK) ^ first) + second + i * draws.SECOND) & draws.MASK)
        out[h * n >> 32] += 1
    return out


@pytest.mark.parametrize("n", [1, 2, 997])
def test_flat_draws(n):
    for draw in (0, 3, draws.BLOCK_DRAWS, 3 * draws.BLOCK_DRAWS - 1):
        assert (draws.slot_weights(n, draw, 17) == plain(n, draw, 17)).all()


def test_any_range_is_a_slice():
    whole = draws.weights_at(np.arange(N), N, 1, 17)
    assert (whole.sum(axis=1) == N).all()
    rng = np.random.default_rng(2)
    for slots in (np.arange(1000, 3000), np.array([N - 1]), np.unique(rng.integers(0, N, 500)), rng.integers(0, N, 50)):
        draws._drawn.cache_clear()
        draws.leaf_weights.cache_clear()
        assert (draws.weights_at(slots, N, 1, 17) == whole[:, slots]).all()


def test_tree_is_a_resample():
    """Mean and variance 1, 37 % left out, no patient favoured, draws and patients unrelated, halves as a binomial has them."""
    w = draws.weights_at(np.arange(N), N, 0, 17).astype(float)
    assert abs(w.var() - 1) < 0.01 and abs((w == 0).mean() - np.exp(-1)) < 0.002
    assert abs(w.mean(axis=0).std() - draws.BLOCK_DRAWS**-0.5) < 0.002
    between = np.corrcoef(w)[np.triu_indices(len(w), 1)]
    assert abs(between.mean()) < 0.001 and abs(between.std() - N**-0.5) < 0.1 * N**-0.5
    for share in (0.5, 0.013):
        held = w[:, : int(share * N)].sum(axis=1)
        p = int(share * N) / N
        assert abs(held.mean() / (N * p) - 1) < 4 * ((1 - p) / (N * p * len(w))) ** 0.5 and 0.7 < held.var() / (N * p * (1 - p)) < 1.4
    leaf = w[:, : draws.LEAF]
    assert abs(np.corrcoef(leaf[:, ::2].sum(axis=1), leaf[:, 1::2].sum(axis=1))[0, 1]) < 0.25
    assert (draws.weights_at(np.arange(300), N, 0, 18) != w[:, :300]).mean() > 0.5


def test_many_patients():
    """A leaf of a hundred million patients, and of more than 32 bits of them, needs nothing of the others."""
    for n in (10**8, 10**10):
        w = draws.weights_at(np.arange(n // 2, n // 2 + 512), n, 3, 17)
        assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
    far = np.arange(100) + (1 << 33)
    assert (draws.poisson_weights(far, 0, 17) != draws.poisson_weights(np.arange(100), 0, 17)).any()


def test_bootstrap_of_many_patients(spark):
    """Rows that carry their weights over ranges of patients give what weighing each draw's rows gives; equal scores lie in several batches."""
    score = F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.round(F.rand(1), 2))
    pred = spark.range(N).select(F.col("id").alias("patient_id"), F.lit(0).alias("run_id"), (F.col("id") % 2).cast("int").alias("class_idx"), score.alias("score"))
    pred = stage(pred.withColumn("label", (F.rand(2) < 0.1 + 0.3 * F.col("score")).cast("int")).withColumn("fired", (F.col("score") > 0.4).cast("int")), "many")
    rows = stage(bootstrap.weighted_rows(pred, 2), "many_rows")
    assert [r[0] for r in rows.groupBy("draw").agg(F.sum("weight")).select("sum(weight)").collect()] == [N, N]
    keys = ["draw", "run_id", "class_idx"]
    want = {(r.draw, r.class_idx): (r.auroc, r.auprc) for r in ranking.rank_metrics(rows, keys, "weight").collect()}
    got = {(r.draw, r.class_idx): (r.auroc, r.auprc) for r in bootstrap.bootstrap_rank(pred, 2).collect()}
    assert len(want) == 4 and got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    hit = F.sum(F.col("weight") * F.col("fired") * F.col("label")) / F.sum(F.col("weight") * F.col("label"))
    want = {(r.draw, r.class_idx): r.recall for r in rows.groupBy(*keys).agg(hit.alias("recall")).collect()}
    got = {(r.draw, r.class_idx): r.recall for r in bootstrap.bootstrap_rates(pred, 2).collect()}
    assert got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
