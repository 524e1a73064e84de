"""Writers of predictions, thresholds, reports, tables and splits."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeval.staging import stage

RUN = ("experiment", "model", "split")


def write_predictions(pred: DataFrame, path: str, enabled: bool = True) -> None:
    """Predictions in a folder for each experiment, model and split; only the folders that `pred` has rows for are replaced."""
    if enabled:
        # rows of a run are spread over tasks, so that one large run is not one task's
        pred.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN).parquet(path)


def save_members(pred: DataFrame, table: str, bucket_rows: int = 1_000_000) -> DataFrame:
    """Predictions of several runs as a table bucketed and sorted by study, and read from there: checks of members, combinations and co-moments of runs, which
    need a study's rows together, then take no shuffle. Buckets follow the number of rows."""
    buckets = max(1, -(-pred.count() // bucket_rows))
    dealt = pred.repartition(buckets, "study_id").sortWithinPartitions("study_id", "class_idx")  # one file a bucket
    dealt.write.mode("overwrite").bucketBy(buckets, "study_id").sortBy("study_id", "class_idx").saveAsTable(table)
    return pred.sparkSession.table(table)


def write_thresholds(thresholds: DataFrame, path: str, settings: Mapping[str, object]) -> None:
    """Thresholds with the settings they were tuned under."""
    thresholds.withColumn("settings", F.lit(json.dumps(dict(settings), sort_keys=True))).write.mode("overwrite").parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    """A JSON document for each run, path/experiment/results/model_results.json, of its columns but experiment and model; nested ones stay nested.

    results: one row a run; two of one run raise. Documents are those of runs, so that they pass the driver one by one. Fields that are null are left out.
    """
    spark = results.sparkSession
    rest = [c for c in results.columns if c not in ("experiment", "model")]
    docs = stage(results.select("experiment", "model", F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("doc")), "results")
    twice = docs.groupBy("experiment", "model").count().where("count > 1 or experiment is null or model is null").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['count']} results of the run {twice[0].experiment}:{twice[0].model}")
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for r in docs.toLocalIterator():
        to = hadoop.Path(f"{path}/{r.experiment}/results/{r.model}_results.json")
        out = to.getFileSystem(conf).create(to, True)
        try:
            out.write(bytearray((r.doc or "{}").encode()))
        finally:
            out.close()


def write_report(report: DataFrame, path: str) -> None:
    """A report's rows as one JSON document for each run, in `rows`; sources.read_results reads them back."""
    rest = [F.col(f"`{c}`") for c in report.columns if c not in ("experiment", "model")]
    write_results(report.groupBy("experiment", "model").agg(F.collect_list(F.struct(*rest)).alias("rows")), path)  # a report's rows of one run


def write_table(table: DataFrame, path: str) -> None:
    """A comparison table (runs by metrics) as one CSV file with a header."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_splits(studies: DataFrame, path: str) -> None:
    """Membership of each split in its own folder."""
    studies.write.mode("overwrite").partitionBy("split").parquet(path)
