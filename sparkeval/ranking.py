"""Exact threshold sweeps, AUROC and average precision for any number of runs and classes.

Scores are first counted per (key, score), so that equal scores enter together. Counts are dealt over ranges of scores: a task sorts and adds up the
distinct scores of one range, and sums over the ranges before it join the ranges, however many scores a class has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeval.staging import before_parts, checked, running, same_keys, stage

KEYS = ("run_id", "class_idx")
LOW_BITS = 20


def score_counts(pred: DataFrame, keys: Sequence[str] = KEYS, weight: str | None = None) -> DataFrame:
    """Positives and rows at each score; a row counts `weight` times where a weight column is named."""
    times = F.col(weight) if weight else F.lit(1)
    return pred.groupBy(*keys, "score").agg(F.sum(F.col("label") * times).cast("long").alias("pos"), F.sum(times).cast("long").alias("n"))


def swept(counts: DataFrame, keys: Sequence[str] = KEYS, *more: str, parts: int | None = None, repeated: bool = False) -> DataFrame:
    """counts (key, score, pos, n, and more) with tp and fp at each score as a threshold that takes scores equal to it, and the key's p and total.

    repeated: a key may have a score in several rows, which are added up where they meet in their range. The ranges are staged with sums over their rows, so that
    reading the result several times takes no shuffle. Without `parts` there are as many ranges as shuffle partitions.
    """
    down = F.desc("score")
    c = counts.repartitionByRange(parts, *keys, down) if parts else counts.repartitionByRange(*keys, down)
    c = c.select(*keys, "score", "pos", "n", *more).sortWithinPartitions(*keys, down).withColumn("part", F.spark_partition_id())
    c = stage(running(c, ("pos", "n"), (*keys, "score") if repeated else (), more), "score_ranges")  # equal scores share a range
    # sums run over all keys of a range, so a key's own begin at its first row; a row for each range, and one more for each key
    first = {f"{x}_first": F.min(F.col(f"{x}_run") - F.coalesce(x, F.lit(0))) for x in ("pos", "n")}
    c = same_keys(c, checked(before_parts(c, keys, {"pos": F.sum("pos"), "n": F.sum("n")}, first), "score_ranges_before"), [*keys, "part"])
    c = c.withColumns({"tp": F.col("pos_run") - F.col("pos_first") + F.col("pos_before"), "called": F.col("n_run") - F.col("n_first") + F.col("n_before")})
    return c.select(*keys, "score", "pos", "n", *more, "tp", (F.col("called") - F.col("tp")).alias("fp"), F.col("pos_all").alias("p"), F.col("n_all").alias("total"))


def confusion_sweep(pred: DataFrame, keys: Sequence[str] = KEYS, weight: str | None = None) -> DataFrame:
    """tp, fp, fn and tn at each distinct score, as a threshold that takes scores equal to it."""
    c = swept(score_counts(pred, keys, weight), keys)
    return c.select(*keys, "score", "pos", "n", "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("total") - F.col("p") - F.col("fp")).alias("tn"))


def rank_sums() -> list[Column]:
    """support, n, auroc (null unless both outcomes occur) and auprc (null without positives) as aggregates over the steps of a sweep."""
    neg = F.col("n") - F.col("pos")
    # negatives below a score are the true negatives there; products of counts outgrow a long, so their upper and lower bits are added up apart (good for 2 ** 43 positives)
    below = 2 * (F.col("total") - F.col("p") - F.col("fp")) + neg
    high, low = F.sum(F.col("pos") * F.shiftright(below, LOW_BITS)), F.sum(F.col("pos") * below.bitwiseAND((1 << LOW_BITS) - 1))
    area = high.cast("decimal(19,0)") * F.lit(1 << LOW_BITS).cast("decimal(8,0)") + low.cast("decimal(19,0)")
    positives, negatives = F.sum("pos"), F.sum(neg)
    precision = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    auroc = F.try_divide(area.cast("double"), 2.0 * positives * negatives)
    return [positives.alias("support"), F.sum("n").alias("n"), auroc.alias("auroc"), F.try_divide(precision, positives).alias("auprc")]


def rank_metrics(pred: DataFrame, keys: Sequence[str] = KEYS, weight: str | None = None) -> DataFrame:
    """support, n, auroc and auprc for each key."""
    return swept(score_counts(pred, keys, weight), keys).groupBy(*keys).agg(*rank_sums())


def macro(metrics: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Averages over classes that have a value; null if none has."""
    return metrics.groupBy(*keys).agg(*[F.avg(c).alias(f"macro_{c}") for c in columns])


def epoch_metrics(pred: DataFrame, keys: Sequence[str] = ("run_id", "epoch"), class_col: str = "class_idx") -> DataFrame:
    """Macro AUROC and average precision of each epoch, 0 where no class has one."""
    m = macro(rank_metrics(pred, (*keys, class_col)), keys, ["auroc", "auprc"])
    return m.na.fill(0.0, ["macro_auroc", "macro_auprc"])
