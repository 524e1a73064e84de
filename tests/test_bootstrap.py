import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkeval import bootstrap, ranking, thresholds
from sparkeval import draws as weights
from sparkeval.bridge import predictions
from sparkeval.queries import DRAWS, QUERIES
from sparkeval.staging import stage

FOLDER = "/root/testdata/sf0.001"
KEYS = ["draw", "run_id", "class_idx"]


def _close(got, want, columns):
    a, b = ({tuple(r[k] for k in KEYS): tuple(r[c] for c in columns) for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and len(a) > 0
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9), k


@pytest.mark.parametrize("n", [1000, 4096])
def test_weights_are_a_resample(n):
    """n draws with replacement: mean and variance 1 for every patient, 37 % left out, no patient favoured, draws unrelated."""
    w = np.stack([weights.slot_weights(n, d, 17) for d in range(400)])
    assert (w.sum(axis=1) == n).all()
    assert abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005
    assert abs(w.mean(axis=0).std() - 0.05) < 0.005 and abs(w.mean(axis=0) - 1).max() < 0.25
    between = np.corrcoef(w)[np.triu_indices(400, 1)]
    assert abs(between.mean()) < 0.002 and abs(between.std() - n**-0.5) < 0.1 * n**-0.5
    other = np.stack([weights.slot_weights(n, d, 18) for d in range(20)])
    assert abs(np.corrcoef(other, w[:20])[:20, 20:]).max() < 5 * n**-0.5
    p = np.stack([weights.poisson_weights(np.arange(n), d, 17) for d in range(400)])
    assert abs(p.mean() - 1) < 0.01 and abs(p.var() - 1) < 0.02 and abs(p.mean(axis=0).std() - 0.05) < 0.005


def test_weight_table_equals_weights(spark):
    got = bootstrap.draw_weights(spark.range(300).select(F.col("id").alias("slot")), 3).collect()
    for d in range(3):
        want = weights.slot_weights(300, d, 17)
        assert {r.slot: r.weight for r in got if r.draw == d} == {i: w for i, w in enumerate(want) if w}


def test_registered_draws(spark):
    """The reference's 1000 draws reach the results."""
    assert DRAWS == 1000
    got = QUERIES["bootstrap_rates"](spark, FOLDER)
    assert {r.draw for r in got.select("draw").distinct().collect()} == set(range(1000))


def test_packed_draws_equal_weighted_rows(spark):
    """Against the sweep of every draw's own rows, over a border of blocks and over several ranges; scores rounded so that many are equal."""
    pred = stage(predictions(spark, FOLDER).where("split = 'val' and run_id < 2").withColumn("score", F.round("score", 2)), "pred")
    draws = weights.BLOCK_DRAWS + 3
    rows = stage(bootstrap.weighted_rows(pred, draws), "rows")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _close(bootstrap.bootstrap_rank(pred, draws), ranking.rank_metrics(rows, KEYS, "weight"), ["auroc", "auprc"])
        for objective in thresholds.OBJECTIVES:
            want = thresholds.tune(rows, objective, KEYS, weight="weight")
            tuned = F.col("status") == "tuned"
            want = want.select(*KEYS, *[F.when(tuned, F.col(c)).alias(c) for c in ("threshold", "objective")])
            _close(bootstrap.bootstrap_thresholds(pred, objective, draws), want, ["threshold", "objective"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_string_patients_and_wider_intervals(spark):
    """Ids such as 007x; six equal rows of a patient give a wider interval than rows drawn one by one."""
    rng = np.random.default_rng(3)
    rows = []
    for p in range(100):
        label, score = int(rng.random() < 0.4), float(np.round(rng.random(), 3))
        rows += [(f"{p:03d}x", p * 6 + k, 0, 0, label, 0.3 * label + 0.7 * score) for k in range(6)]
    pred = spark.createDataFrame(rows, "patient_id string, study_id long, run_id int, class_idx int, label int, score double")
    width = {}
    for name, df in (("patients", pred), ("rows", pred.withColumn("patient_id", F.col("study_id").cast("string")))):
        r = bootstrap.percentile_interval(bootstrap.bootstrap_rank(df, 200), "auroc", ("run_id", "class_idx"), 200).first()
        width[name] = r.ci_high - r.ci_low
    assert width["patients"] > 1.5 * width["rows"]
    poisson = bootstrap.percentile_interval(bootstrap.bootstrap_rank(pred, 200, scheme="poisson"), "auroc", ("run_id", "class_idx"), 200).first()
    assert abs((poisson.ci_high - poisson.ci_low) / width["patients"] - 1) < 0.4
