import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkeval import ensemble, stacking

CELLS = "run_id int, study_id long, patient_id long, class_idx int, label int, score double, split string"


@pytest.fixture(scope="module")
def members():
    rng, rows = np.random.default_rng(3), []
    for k, share in enumerate([0.3, 0.05]):
        label = (rng.random(600) < share).astype(int)
        for run, strength in enumerate([0.4, 0.2, 0.0]):
            score = strength * label + (1 - strength) * rng.random(600)
            rows += [(run, i, i // 2, k, int(label[i]), float(score[i]), "val") for i in range(600)]
    return rows


def newton(x, y, c):
    w, ridge = np.zeros(x.shape[1]), np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(c * (x * (p * (1 - p))[:, None]).T @ x + ridge, c * x.T @ (p - y) + ridge @ w)
    return w


def test_stackers_match_a_fit_in_memory(spark, members):
    pred = spark.createDataFrame(members, CELLS)
    val, test, models = stacking.stacked_predictions(pred, pred, 3)
    got = {(r.class_idx, r.fold): np.array(r.w) for r in models.collect()}
    f = val.select("study_id", "patient_id", "class_idx", "label", "fold", "score", "mean").toPandas()
    assert len(f) == 1200 and f.groupby("patient_id").fold.nunique().max() == 1 and f.fold.nunique() == 5
    wide = pd.DataFrame(members, columns=[c.split()[0] for c in CELLS.split(", ")]).pivot(index=["class_idx", "study_id"], columns="run_id", values="score")
    p = np.clip(wide.to_numpy(), 1e-6, 1 - 1e-6)
    x = pd.DataFrame(np.column_stack([np.ones(len(p)), np.log(p / (1 - p))]), index=wide.index)
    assert {k for k, _ in got} == {0}  # the second class has too few positives and keeps the mean
    for fold in range(-1, 5):
        part = f[(f.class_idx == 0) & (f.fold != fold)]
        want = newton(x.loc[[(0, i) for i in part.study_id]].to_numpy(), part.label.to_numpy(), 0.3)
        assert np.allclose(got[0, fold], want, atol=1e-6)
    rare = f[f.class_idx == 1]
    assert np.allclose(rare.score, rare["mean"])
    t = test.where("class_idx = 0").orderBy("study_id").toPandas()
    assert np.allclose(t.score, 1 / (1 + np.exp(-x.loc[0].to_numpy() @ got[0, -1])), atol=1e-9)


def test_nothing_to_fit(spark, members):
    pred = spark.createDataFrame(members, CELLS).where("class_idx = 1")
    val, _, models = stacking.stacked_predictions(pred, pred, 3)
    assert models.count() == 0 and val.where(F.abs(F.col("score") - F.col("mean")) > 0).count() == 0


def test_diverse_members(spark, members):
    pred = spark.createDataFrame(members, CELLS)
    got = stacking.select_diverse(pred, ensemble.residual_correlation(pred), floor=0.6)
    status = {r["run_id"]: r["status"] for r in got}
    assert status[0] == "selected 1" and status[2] == "below floor" and status[1] in ("selected 2", "no gain")
    both = ensemble.run_auroc(ensemble.combine(pred.where("run_id < 2")).withColumn("run_id", F.lit(9))).first().macro_auroc
    assert (status[1] == "selected 2") == (both > got[0]["macro_auroc"])


def test_co_moments_of_tasks_are_merged(spark):
    """Against numpy over each pair's common studies: runs that lack studies, scores far from 0, a constant run, strata of few studies."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(900):
        for k in range(2):
            base = rng.normal()
            for r in range(5):
                if rng.random() < 0.85 or r == 0:
                    score = {3: 0.25, 4: 1e6 + base}.get(r, float(base * r + rng.normal()))
                    rows.append((r, i, k, int(i % 40 == 0 if k else i % 3 == 0), score))
    pred = spark.createDataFrame(rows, "run_id int, study_id long, class_idx int, label int, score double").repartition(7)
    at = {}
    for r, i, k, y, x in rows:
        at.setdefault((k, y), {}).setdefault(r, {})[i] = x
    want = {}
    for runs in at.values():
        for a in range(5):
            for b in range(a + 1, 5):
                both = sorted(runs[a].keys() & runs[b].keys())
                x, y = np.array([runs[a][i] for i in both]), np.array([runs[b][i] for i in both])
                if len(both) >= 30 and x.std() >= 1e-12 and y.std() >= 1e-12:
                    want.setdefault((a, b), []).append(np.corrcoef(x, y)[0, 1])
    got = {(r.a, r.b): r.correlation for r in ensemble.residual_correlation(pred).collect()}
    assert len(got) == 6 and got == {k: pytest.approx(np.mean(v), abs=1e-8) for k, v in want.items()}
