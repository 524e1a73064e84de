"""Training histories, timing logs and tables that compare runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def early_stop(history: DataFrame, metric: str = "value", maximize: bool = True, patience: int = 5) -> DataFrame:
    """The epochs each run trains, with `improved` (strictly better than all before) and `waited` (epochs since then).

    history: run_id, epoch and the metric, one row for each epoch. A null metric never improves.
    """
    w = Window.partitionBy("run_id").orderBy("epoch")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    value = F.col(metric) if maximize else -F.col(metric)
    best = F.max(value).over(before)
    h = history.withColumn("improved", value.isNotNull() & (best.isNull() | (value > best))).withColumn("place", F.row_number().over(w))
    last = F.coalesce(F.max(F.when(F.col("improved"), F.col("place"))).over(upto), F.lit(0))
    h = h.withColumn("waited", F.col("place") - last)
    over = F.coalesce(F.max((F.col("waited") >= patience).cast("int")).over(before), F.lit(0))
    return h.withColumn("over", over).where("over = 0").drop("over", "place")


def training_summary(stopped: DataFrame, metric: str = "value") -> DataFrame:
    """Total and mean seconds, epochs, best epoch, seconds up to it, and the last epoch's metric of each run."""
    best = F.max(F.when(F.col("improved"), F.col("epoch"))).over(Window.partitionBy("run_id"))
    s = stopped.withColumn("best", best).groupBy("run_id")
    return s.agg(
        F.sum("seconds").alias("total_seconds"), F.count("*").alias("epochs"), F.avg("seconds").alias("epoch_seconds"), F.max("best").alias("best_epoch"),
        F.sum(F.when(F.col("epoch") <= F.col("best"), F.col("seconds"))).alias("seconds_to_best"), F.max_by(metric, "epoch").alias("last_value"),
    )


def throughput(batches: DataFrame) -> DataFrame:
    """Images and seconds of each run, and images a second without its first batch, which pays for warming up; null if there is no other."""
    b = batches.groupBy("run_id").agg(
        F.count("*").alias("batches"), F.sum("images").alias("images"), F.sum("seconds").alias("seconds"),
        F.min_by("images", "batch_idx").alias("first_images"), F.min_by("seconds", "batch_idx").alias("first_seconds"),
    )
    warm = F.try_divide(F.col("images") - F.col("first_images"), F.col("seconds") - F.col("first_seconds"))
    return b.select("run_id", "batches", "images", "seconds", F.when(F.col("batches") > 1, warm).alias("images_per_second"))


def compare_runs(results: DataFrame, runs: Sequence[str], metrics: Sequence[str], name: str = "experiment") -> DataFrame:
    """A row for each metric and a column for each of `runs`; null where a run has none."""
    return results.unpivot([name], list(metrics), "metric", "value").groupBy("metric").pivot(name, list(runs)).agg(F.first("value"))


def check_comparable(results: DataFrame, name: str = "experiment", classes: str = "class_name") -> None:
    """Raise if runs do not hold the same classes."""
    sets = results.groupBy(name).agg(F.array_sort(F.collect_set(classes)).alias("classes")).groupBy("classes").agg(F.min(name).alias("run")).limit(2).collect()
    if len(sets) > 1:
        raise ValueError(f"{sets[0]['run']} and {sets[1]['run']} hold different classes")


def localization_table(results: DataFrame) -> DataFrame:
    """Runs' localization by method, the best pointing first; overlap of boxes is left out, as grids differ between models.

    results: experiment, model, method and `macro` with pointing_game, energy_fraction and random_baseline; runs without it are skipped.
    """
    columns = ("pointing_game", "energy_fraction", "random_baseline")
    t = results.where("macro.pointing_game IS NOT NULL").select("experiment", "model", "method", *[F.col(f"macro.{c}").alias(c) for c in columns])
    return t.orderBy("method", F.desc("pointing_game"), "experiment", "model")
