"""Threshold calibration on a sweep, and its application."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeval.ranking import KEYS, confusion_sweep
from sparkeval.staging import checked, same_keys

OBJECTIVES = ("f1", "fbeta", "youden", "sensitivity")
MIN_SUPPORT, DEFAULT, TIE = 50, 0.5, 1e-12


def safe_ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den), F.lit(0.0))


def check_objective(objective: str) -> None:
    if objective not in OBJECTIVES:
        raise ValueError(f"unknown objective {objective}; one of {', '.join(OBJECTIVES)}")


def tune(pred: DataFrame, objective: str = "f1", keys: Sequence[str] = KEYS, beta: float = 2.0, target: float = 0.8, min_support: int = MIN_SUPPORT, weight: str | None = None) -> DataFrame:
    """threshold and status of each key: the loosest of the best candidates, or 0.5 where support or the objective don't allow it.

    With them the objective's value (for sensitivity the specificity of the strictest candidate that reaches the target), the rates there
    and the number of candidates; rates are null unless the status is tuned, the value is null for the status default.
    """
    check_objective(objective)
    s = confusion_sweep(pred, keys, weight)
    precision, recall = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    specificity = safe_ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    b = 1.0 if objective == "f1" else beta * beta
    value = safe_ratio((1 + b) * precision * recall, b * precision + recall)
    if objective == "youden":
        value = recall + specificity - 1
    if objective == "sensitivity":
        value = F.when(recall >= target, specificity)
    s = s.withColumns({"value": value, "precision": precision, "recall": recall, "specificity": specificity})
    at = F.struct("score", "value", "precision", "recall", "specificity")
    if objective == "sensitivity":
        pick = F.max(F.when(F.col("value").isNotNull(), at))
    else:
        s = same_keys(s, checked(s.groupBy(*keys).agg(F.max("value").alias("best")), "best_values"), keys)  # a row for each key
        pick = F.min(F.when(F.col("value") >= F.col("best") - TIE, at))
    out = s.groupBy(*keys).agg(F.sum("pos").alias("support"), F.sum("n").alias("n"), F.count("*").alias("candidates"), pick.alias("at"))
    status = F.when((F.col("support") < min_support) | (F.col("support") == F.col("n")), "default").when(F.coalesce("at.value", F.lit(0.0)) <= 0, "degenerate").otherwise("tuned")
    out = out.withColumn("status", status)
    tuned = F.col("status") == "tuned"
    return out.select(
        *keys, "support", F.when(tuned, F.col("at.score")).otherwise(DEFAULT).alias("threshold"), "status",
        F.when(F.col("status") != "default", F.col("at.value")).alias("objective"),
        *[F.when(tuned, F.col(f"at.{c}")).alias(c) for c in ("precision", "recall", "specificity")], F.when(tuned, F.col("candidates")).alias("candidates"),
    )


def apply_thresholds(pred: DataFrame, thresholds: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """pred with `fired`: the score reaches its key's threshold, or 0.5 where there is none."""
    t = checked(thresholds.select(*keys, "threshold"), "applied_thresholds")  # a row for each key
    return pred.join(t, list(keys), "left").withColumn("fired", (F.col("score") >= F.coalesce("threshold", F.lit(DEFAULT))).cast("int"))


def class_rates(fired: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Confusion counts, precision, recall and F1, 0 where a denominator is 0."""
    c = fired.groupBy(*keys).agg(F.sum(F.col("fired") * F.col("label")).alias("tp"), F.sum("fired").alias("called"), F.sum("label").alias("support"))
    p, r = safe_ratio(F.col("tp"), F.col("called")), safe_ratio(F.col("tp"), F.col("support"))
    return c.withColumns({"precision": p, "recall": r, "f1": safe_ratio(2 * F.col("tp"), F.col("called") + F.col("support"))})
