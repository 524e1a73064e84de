"""Combining and comparing runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkeval.ranking import macro, rank_metrics, score_counts, swept
from sparkeval.staging import checked, numbered, same_keys, stage

EPS = 1e-6
_ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}


def log_odds(p: Column) -> Column:
    c = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return F.ln(c / (1 - c))


def rank_transform(pred: DataFrame) -> DataFrame:
    """Scores as places in [0, 1] within run and class; equal scores in the order of the study."""
    keys = ["run_id", "class_idx"]
    rows = pred.groupBy(*keys).agg(F.count("*").alias("__rows"))
    placed = same_keys(numbered(pred, keys, ["score", "study_id"], "score_places", "__place"), checked(rows, "score_rows"), keys)  # a row for each key
    return placed.withColumn("score", F.col("__place") / F.greatest(F.col("__rows") - 1, F.lit(1))).drop("__place", "__rows")


def combine(pred: DataFrame, rule: str = "mean") -> DataFrame:
    """One score per study and class over all runs: mean, mean log-odds, or mean rank."""
    if rule not in ("mean", "logit", "rank"):
        raise ValueError(f"unknown rule {rule}")
    pred = rank_transform(pred) if rule == "rank" else pred
    score = F.avg(log_odds(F.col("score"))) if rule == "logit" else F.avg("score")
    slot = [F.min("slot").alias("slot")] if "slot" in pred.columns else []
    out = pred.groupBy("split", "study_id", "class_idx").agg(F.min("patient_id").alias("patient_id"), F.max("label").alias("label"), score.alias("score"), *slot)
    out = out.withColumn("score", 1 / (1 + F.exp(-F.col("score")))) if rule == "logit" else out
    return out.withColumn("score", F.round("score", 12))  # sums in another order keep their ties


def run_auroc(pred: DataFrame) -> DataFrame:
    return macro(rank_metrics(pred, ("run_id", "split", "class_idx")), ("run_id", "split"), ["auroc", "auprc"])


def select_members(pred: DataFrame, runs: DataFrame, floor: float = 0.75) -> DataFrame:
    """The best run of each model on validation, with a status for every run."""
    v = run_auroc(pred.where("split = 'val'")).join(checked(runs, "runs"), "run_id")  # a row for each run
    first = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("macro_auroc"), "experiment"))
    best = F.first("experiment").over(Window.partitionBy("model").orderBy(F.desc("macro_auroc"), "experiment"))
    status = F.when(F.col("macro_auroc").isNull(), "unscorable").when(F.col("macro_auroc") < floor, "below floor").when(first == 1, "selected").otherwise(F.concat(F.lit("beaten within family by "), best))
    return v.select("run_id", "experiment", "model", "macro_auroc", status.alias("status"))


def _moments(x: np.ndarray) -> np.ndarray:
    """Of rows by runs, for each pair of runs over the rows that have both: rows, means of either, sums of squared deviations of either, of their products."""
    there = ~np.isnan(x)
    some = there.any(axis=0)
    pivot = np.where(some, np.where(there, x, 0.0).sum(axis=0) / np.maximum(there.sum(axis=0), 1), 0.0)
    d, m = np.where(there, x - pivot, 0.0), there.astype(np.float64)  # deviations, so that squares stay of their size
    n, sa, saa, sab = m.T @ m, d.T @ m, (d * d).T @ m, d.T @ d
    of = np.maximum(n, 1)
    return np.stack([n, pivot[:, None] + sa / of, pivot[None, :] + sa.T / of, np.maximum(saa - sa * sa / of, 0), np.maximum(saa.T - sa.T * sa.T / of, 0), sab - sa * sa.T / of])


def _merged(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Moments of two sets of rows together."""
    n = p[0] + q[0]
    of, da, db = np.maximum(n, 1), q[1] - p[1], q[2] - p[2]
    w = p[0] * q[0] / of
    out = np.stack([n, p[1] + da * q[0] / of, p[2] + db * q[0] / of, p[3] + q[3] + da * da * w, p[4] + q[4] + db * db * w, p[5] + q[5] + da * db * w])
    return np.where(p[0] == 0, q, np.where(q[0] == 0, p, out))


def co_moments(pred: DataFrame) -> DataFrame:
    """a, b, class_idx, label, n and the deviations' sums of squares aa and bb and of products ab, for each pair of runs a < b over the studies that both score.

    A study's scores meet in one row, a value a run; a task adds up one matrix of co-moments for each class and label, and tasks' matrices are merged. Of two scores
    of one run for a study the larger one counts.
    """
    kinds, keys = dict(pred.dtypes), ("class_idx", "label", "a", "b")
    cells = pred.groupBy("study_id", "class_idx").agg(F.max("label").alias("label"), F.sort_array(F.collect_list(F.struct("run_id", "score"))).alias("s"))
    cells = cells.select("class_idx", "label", F.col("s.run_id").alias("runs"), F.col("s.score").cast("array<double>").alias("scores"))
    kinds = {"class_idx": kinds["class_idx"], "label": kinds["label"], "a": kinds["run_id"], "b": kinds["run_id"]}
    names = ("n", "ma", "mb", "aa", "bb", "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("runs")
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            runs, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            x = np.full((batch.num_rows, len(runs)), np.nan)
            x[row, place] = batch.column("scores").flatten().to_numpy(zero_copy_only=False)
            strata, of = np.unique(np.stack([batch.column(k).to_numpy() for k in ("class_idx", "label")]), axis=1, return_inverse=True)
            for k, stratum in enumerate(strata.T):
                key, m = (tuple(runs.tolist()), *stratum.tolist()), _moments(x[of.reshape(-1) == k])
                held[key] = _merged(held[key], m) if key in held else m
        for (runs, klass, label), m in held.items():
            i, j = np.triu_indices(len(runs), 1)
            at = np.array(runs)
            columns = [np.full(len(i), klass), np.full(len(i), label), at[i], at[j], *m[:, i, j]]
            arrays = [pa.array(c, _ARROW[t]) for c, t in zip(columns, kinds.values())]
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(c) for c in columns[4:]]], [*kinds, *names])

    parts = cells.mapInArrow(run, ", ".join([*[f"{k} {t}" for k, t in kinds.items()], *[f"{c} double" for c in names]])).where("n > 0")
    w = Window.partitionBy(*keys)  # a row for each task
    da, db = (F.col(c) - F.sum(F.col("n") * F.col(c)).over(w) / F.sum("n").over(w) for c in ("ma", "mb"))
    d = parts.select(*keys, "n", "aa", "bb", "ab", da.alias("da"), db.alias("db")).groupBy(*keys)
    sums = {"aa": F.col("aa") + F.col("n") * F.col("da") ** 2, "bb": F.col("bb") + F.col("n") * F.col("db") ** 2, "ab": F.col("ab") + F.col("n") * F.col("da") * F.col("db")}
    return d.agg(F.sum("n").alias("n"), *[F.sum(v).alias(k) for k, v in sums.items()])


def residual_correlation(pred: DataFrame, least: int = 30) -> DataFrame:
    """Mean correlation of two runs' scores within the strata of class and label; strata with few studies or constant scores are left out."""
    s = co_moments(pred).where((F.col("n") >= least) & (F.sqrt(F.col("aa") / F.col("n")) >= 1e-12) & (F.sqrt(F.col("bb") / F.col("n")) >= 1e-12))
    return s.groupBy("a", "b").agg(F.avg(F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("correlation"))


def top_flags(pred: DataFrame) -> DataFrame:
    """The k highest scores of each run and class, k being the class's positives.

    Counts per score tell where a key's last flag stands; only rows of that score are put in order, by their study.
    """
    keys = ["run_id", "class_idx"]
    s = swept(score_counts(pred, keys), keys).withColumn("called", F.col("tp") + F.col("fp"))
    reached = F.col("called") >= F.col("p")
    cuts = s.groupBy(*keys).agg(F.max("p").alias("k"), F.max(F.when(reached, F.col("score"))).alias("cut"), F.coalesce(F.max(F.when(~reached, F.col("called"))), F.lit(0)).alias("above"))
    rows = same_keys(pred.select(*keys, "study_id", "score"), checked(cuts, "top_sizes"), keys)  # a row for each key
    over = (F.col("score") > F.col("cut")) | (F.col("cut").isNull() & F.col("score").isNotNull())
    last = numbered(rows.where(F.col("score").eqNullSafe(F.col("cut"))), keys, ["study_id"], "top_places").where("place < k - above")
    return rows.where(over).unionByName(last.drop("place")).select(*keys, "study_id", "k")


def decision_disagreement(pred: DataFrame, least: int = 30) -> DataFrame:
    t = stage(top_flags(pred).where(F.col("k") >= least), "top_flags")
    o = t.select(F.col("run_id").alias("b"), "class_idx", "study_id")
    both = t.withColumnRenamed("run_id", "a").join(o, ["class_idx", "study_id"]).where("a < b").groupBy("a", "b", "class_idx").agg(F.count("*").alias("n"), F.max("k").alias("k"))
    runs = t.select(F.col("run_id").alias("a"), "class_idx", "k").distinct()
    every = runs.join(runs.select(F.col("a").alias("b"), "class_idx"), "class_idx").where("a < b")
    every = every.join(both.drop("k"), ["a", "b", "class_idx"], "left")
    return every.groupBy("a", "b").agg(F.avg(1 - F.coalesce("n", F.lit(0)) / F.col("k")).alias("disagreement"))


def diversity_table(pred: DataFrame) -> DataFrame:
    """a, b, correlation and disagreement of every ordered pair of different runs: the matrices without their diagonals."""
    pairs = residual_correlation(pred).join(decision_disagreement(pred), ["a", "b"], "full")
    return pairs.union(pairs.select("b", "a", "correlation", "disagreement"))


def diversity_means(table: DataFrame) -> DataFrame:
    return table.agg(F.avg("correlation").alias("correlation"), F.avg("disagreement").alias("disagreement"))


def discover_runs(pred: DataFrame, ensembles: DataFrame, exclude: str | None = None) -> DataFrame:
    """experiment and model of runs with both validation and test rows that are no ensembles themselves nor of the excluded experiment.

    ensembles: experiment and model of runs that were made by combining others.
    """
    runs = pred.groupBy("experiment", "model").agg(F.max((F.col("split") == "val").cast("int")).alias("v"), F.max((F.col("split") == "test").cast("int")).alias("t"))
    found = runs.where("v = 1 and t = 1").select("experiment", "model").join(ensembles, ["experiment", "model"], "left_anti")
    return found if exclude is None else found.where(F.col("experiment") != exclude)
