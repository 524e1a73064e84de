"""Logistic combiners of members' log-odds, one for each class, fitted by Newton steps that Spark sums.

All classes and folds are fitted together: a step is one pass over the rows, in which a task adds up the gradient and the Hessian of every model, and the driver solves a system of members + 1 unknowns for each class and fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeval.ensemble import log_odds
from sparkeval.labels import grouped_folds
from sparkeval.staging import checked, drop_staged, stage

FULL = -1  # the fold of a model fitted on all rows
COEFFICIENTS = "class_idx int, fold int, w array<double>"
SUMS = "class_idx int, fold int, g array<double>, h array<double>"
ARROW_SUMS = pa.schema({"class_idx": pa.int32(), "fold": pa.int32(), "g": pa.list_(pa.float64()), "h": pa.list_(pa.float64())})


def member_features(pred: DataFrame) -> DataFrame:
    """study_id, patient_id, class_idx, label, `x` (a 1, then the members' log-odds by run) and `mean` of the members' scores."""
    g = pred.groupBy("study_id", "class_idx").agg(
        F.min("patient_id").alias("patient_id"), F.max("label").alias("label"), F.avg("score").alias("mean"),
        F.transform(F.array_sort(F.collect_list(F.struct("run_id", "score"))), lambda m: log_odds(m["score"])).alias("x"),
    )
    return g.withColumn("x", F.concat(F.array(F.lit(1.0)), "x"))


def _dot(x: str, w: str):
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _newton_sums(w: dict[tuple[int, int], np.ndarray], size: int):
    """For each task the gradient and the Hessian of the log loss of each model (class and fold) at its coefficients; rows that lack a member count nowhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: (np.zeros(size), np.zeros((size, size))) for k in w}
        for batch in batches:
            lists = batch.column("x")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            klass, fold, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("class_idx", "fold", "label"))
            whole = np.flatnonzero(np.diff(ends) == size)
            x = flat[ends[:-1][whole, None] + np.arange(size)]
            whole, x = (v[~np.isnan(x).any(axis=1)] for v in (whole, x))
            klass, fold, label = klass[whole], fold[whole], label[whole]
            for k in set(klass.tolist()):
                own = klass == k
                xk, yk, fk = x[own], label[own], fold[own]
                for key in w:
                    if key[0] == k:
                        rest = fk != key[1]
                        xs = xk[rest]
                        p = 1 / (1 + np.exp(-(xs @ w[key])))
                        g, h = held[key]
                        g += xs.T @ (p - yk[rest])
                        h += (xs * (p * (1 - p))[:, None]).T @ xs
        for (k, f), (g, h) in held.items():
            yield pa.RecordBatch.from_pylist([{"class_idx": k, "fold": f, "g": g.tolist(), "h": h.ravel().tolist()}], ARROW_SUMS)

    return run


def fit_stackers(features: DataFrame, members: int, c: float = 0.3, min_positives: int = 50, steps: int = 25, tolerance: float = 1e-9) -> DataFrame:
    """class_idx, fold and `w` (intercept first) of the classes with enough positives among the rows a fold's model is fitted on.

    Minimises c times the log loss plus half the squared weights, the intercept free. features: those of member_features with `fold`;
    the model of a fold leaves its rows out, the one of fold -1 takes all. Raises if a model does not settle within `steps`.
    """
    size = members + 1
    own = features.groupBy("class_idx", "fold").agg(F.sum("label").alias("pos"), F.count("*").alias("n")).collect()  # a row for each class and fold
    w = {}
    for fold in [FULL, *sorted({r.fold for r in own})]:
        for klass in {r.class_idx for r in own}:
            pos, n = (sum(r[c] for r in own if r.class_idx == klass and r.fold != fold) for c in ("pos", "n"))
            if min_positives <= pos < n:
                w[klass, fold] = np.zeros(size)
    spark, ridge, open_models = features.sparkSession, np.diag([0.0] + [1.0] * members), set(w)
    for _ in range(steps):
        if not open_models:
            break
        r = features.select("class_idx", "fold", "label", "x").mapInArrow(_newton_sums({k: w[k] for k in open_models}, size), SUMS)
        sums = r.groupBy("class_idx", "fold").agg(*[F.array(*[F.sum(F.col(c)[i]) for i in range(k)]).alias(c) for c, k in (("g", size), ("h", size * size))])
        for s in sums.collect():
            key, h = (s.class_idx, s.fold), np.array(s.h).reshape(size, size)
            step = np.linalg.solve(c * h + ridge, c * np.array(s.g) + ridge @ w[key])
            w[key] = w[key] - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-300))
            if np.abs(step).max() < tolerance:
                open_models.discard(key)
    if open_models:
        raise RuntimeError(f"{len(open_models)} combiners did not settle in {steps} steps")
    return spark.createDataFrame([(k, f, v.tolist()) for (k, f), v in sorted(w.items())], COEFFICIENTS)


def apply_stackers(features: DataFrame, models: DataFrame) -> DataFrame:
    """features with `score` of the row's class and fold; the mean of the members where there is no model."""
    scored = features.join(checked(models, "stackers"), ["class_idx", "fold"], "left")  # a row for each class and fold
    return scored.withColumn("score", F.when(F.col("w").isNull(), F.col("mean")).otherwise(1 / (1 + F.exp(-_dot("x", "w"))))).drop("w", "x")


def stacked_predictions(val: DataFrame, test: DataFrame, members: int, folds: int = 5, c: float = 0.3, min_positives: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Validation scores from models that never saw the patient, test scores from the models of all rows, and the coefficients."""
    own = stage(member_features(val), "member_features")
    f = stage(own.join(grouped_folds(own, folds), "patient_id"), "stacker_features")
    drop_staged(own)
    models = fit_stackers(f, members, c, min_positives)
    return apply_stackers(f, models), apply_stackers(member_features(test).withColumn("fold", F.lit(FULL)), models), models


def select_diverse(pred: DataFrame, correlations: DataFrame, floor: float = 0.75, weight: float = 1.0, most: int = 8) -> list[dict]:
    """Members picked one by one on validation, with a status for every run.

    The best run starts. Then runs over the floor are tried in the order of AUROC less `weight` times their mean correlation with the
    members, and the first one whose mean with them has a higher macro AUROC joins. All sets of a round are scored in one job; runs and
    their pairs are few and live on the driver.
    """
    from sparkeval.ensemble import run_auroc
    from sparkeval.ranking import macro, rank_metrics

    auroc = {r.run_id: r.macro_auroc for r in run_auroc(pred).collect()}
    rho = {}
    for r in correlations.collect():
        rho[r.a, r.b] = rho[r.b, r.a] = r.correlation
    usable = sorted((r for r, a in auroc.items() if a is not None and a >= floor), key=lambda r: (-auroc[r], r))
    status = {r: "unscorable" if a is None else "below floor" for r, a in auroc.items()}
    members, best = usable[:1], auroc[usable[0]] if usable else None
    scores = pred.groupBy("study_id", "class_idx").agg(F.max("label").alias("label"), F.map_from_entries(F.collect_list(F.struct("run_id", "score"))).alias("s")).persist()
    while len(members) < most and (rest := [r for r in usable if r not in members]):
        sets = F.array(*[F.struct(F.lit(r).alias("run_id"), sum((F.col("s")[m] for m in [*members, r]), F.lit(0.0)).alias("total")) for r in rest])
        tried = scores.select("class_idx", "label", F.explode(sets).alias("t")).select("class_idx", "label", "t.run_id", F.round(F.col("t.total") / (len(members) + 1), 12).alias("score"))
        got = {r.run_id: r.macro_auroc for r in macro(rank_metrics(tried), ("run_id",), ["auroc"]).collect()}
        order = sorted(rest, key=lambda r: (-(auroc[r] - weight * float(np.mean([rho.get((r, m), 0.0) for m in members]))), r))
        joins = next((r for r in order if got[r] > best), None)
        if joins is None:
            break
        members, best = [*members, joins], got[joins]
    scores.unpersist()
    status |= {r: "no gain" for r in usable} | {r: f"selected {i}" for i, r in enumerate(members, 1)}
    return [{"run_id": r, "macro_auroc": auroc[r], "status": status[r]} for r in sorted(auroc)]
