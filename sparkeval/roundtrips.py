"""Registered queries that write with the library's sinks, read with its sources, and go on from there; and the same in DuckDB's SQL.

Everything is written below the shared folder and deleted with the application's other tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeval import heatmaps, ranking, runs, sinks, sources, thresholds
from sparkeval.bridge import box_rows, findings, flawed_predictions, maps, predictions, studies
from sparkeval.queries import _FIRED, _K, _RATES, _SCORED, _STUDY, _V, EXPERIMENTS, _again, _fired, _runs, _tuned, rounded
from sparkeval.staging import scratch, stage

CELL = ("run_id", "experiment", "model", "split", "study_id", "patient_id", "class_idx", "label", "score")
BOX_CLASSES = ["Infiltration", *[f"class_{k}" for k in range(2, 10)]]


def saved_predictions(s, d) -> DataFrame:
    """Validation and test predictions of all runs are saved, one run's validation again with half its scores; then each is read by itself."""
    p, path = predictions(s, d).where("split IN ('val', 'test')").select(*CELL), scratch(s, "saved_predictions")
    sinks.write_predictions(p, path)
    sinks.write_predictions(p.where("experiment = 'exp_b' AND split = 'val'").withColumn("score", F.col("score") / 2), path)
    named = _runs(s, d).select("experiment", "model").collect()  # a row for each run
    read = reduce(DataFrame.unionByName, [sources.read_predictions(s, path, r.experiment, r.model, split) for r in named for split in ("val", "test")])
    out = read.groupBy("experiment", "model", "split", "class_idx").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.sum("score").alias("score"), F.max("patient_id").alias("last_patient"))
    return rounded(out, 5)


def saved_thresholds(s, d) -> DataFrame:
    tuned, path = thresholds.tune(predictions(s, d).where("split = 'val'")), scratch(s, "saved_thresholds")
    sinks.write_thresholds(tuned, path, {"objective": "f1", "beta": 2})
    return sources.read_thresholds(s, path).select("run_id", "class_idx", "threshold", "status", "settings")


def _macro(s, d) -> DataFrame:
    test = predictions(s, d).where("split = 'test'")
    return ranking.macro(ranking.rank_metrics(test, ("experiment", "model", "class_idx")), ("experiment", "model"), ["auroc", "auprc"])


def saved_results(s, d) -> DataFrame:
    """A document a run, of which one lacks a field and one has a whole number; compared over the runs as they are read."""
    path = scratch(s, "saved_results")
    r = _macro(s, d).withColumn("macro_auprc", F.when(F.col("experiment") != "exp_c", F.col("macro_auprc"))).withColumn("macro_auroc", F.when(F.col("experiment") == "exp_d", 1.0).otherwise(F.col("macro_auroc")))
    sinks.write_results(r, path)
    return rounded(runs.compare_runs(sources.read_results(s, path, {"macro_auroc": "double", "macro_auprc": "double"}), EXPERIMENTS, ["macro_auroc", "macro_auprc"]))


def saved_report(s, d) -> DataFrame:
    path = scratch(s, "saved_report")
    rates = thresholds.class_rates(_fired(s, d)).unpivot(["run_id", "class_idx"], ["precision", "recall", "f1"], "metric", "value")
    sinks.write_report(rates.join(_runs(s, d), "run_id").drop("run_id"), path)
    return rounded(sources.report_rows(s, path, "class_idx int, metric string, value double"))


def saved_table(s, d) -> DataFrame:
    path = scratch(s, "saved_table")
    sinks.write_table(rounded(_macro(s, d)), path)
    return s.read.schema("experiment string, model string, macro_auroc double, macro_auprc double").option("header", True).csv(path)


def saved_localization(s, d) -> DataFrame:
    path = scratch(s, "saved_localization")
    each = heatmaps.localization_summary(heatmaps.score_maps(maps(s, d), 8, 8))
    means = F.struct(F.avg("pointing").alias("pointing_game"), F.avg("energy").alias("energy_fraction"), F.avg("baseline").alias("random_baseline"))
    one = each.agg(means.alias("macro")).select(F.explode(F.array(F.lit("exp_a"), F.lit("exp_b"))).alias("experiment"), F.lit("net_x").alias("model"), F.lit("map").alias("method"), "macro")
    sinks.write_results(one.withColumn("macro", F.when(F.col("experiment") == "exp_a", F.col("macro"))), path)  # a run without is left out
    read = sources.read_results(s, path, {"method": "string", "macro": "struct<pointing_game double, energy_fraction double, random_baseline double>"})
    return rounded(runs.localization_table(read))


def saved_boxes(s, d) -> DataFrame:
    """Boxes from a CSV on a grid of 4 x 4, joined with their images, two rows for some; and the names that are no classes."""
    path = scratch(s, "saved_boxes")
    sinks.write_table(box_rows(s, d), path)
    known, other = sources.read_boxes(s, path, BOX_CLASSES)
    v = F.col("vec_id")
    images = s.read.parquet(f"{d}/embeddings.parquet").where(v % 7 > 0).select(F.concat(v, F.lit(".png")).alias("image_id"), (8 + v % 3).alias("image_width"), F.lit(16).alias("image_height"))
    found, lost = sources.annotated(known, images.unionByName(images.where("image_width = 9")))
    out = sources.scale_boxes(found, 4, 4).groupBy("finding").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "xywh"])
    none = [F.lit(None).cast("double").alias(c) for c in "xywh"]
    lost = lost.groupBy("finding").agg(F.count("*").alias("n")).select(F.concat(F.lit("lost "), "finding").alias("finding"), "n", *none)
    return rounded(out.unionByName(lost).unionByName(other.select("finding", F.col("count").alias("n"), *none)), 5)


def saved_lists(s, d) -> DataFrame:
    """A list of ids for each split, with blanks around them; studies in each list by sex."""
    p, parts = studies(s, d).withColumn("image_id", F.col("study_id").cast("string")), []
    for split in ("val", "test"):
        path = scratch(s, "saved_list")
        p.where(F.col("split") == split).select(F.concat(F.lit(" "), "image_id", F.lit(" \n"))).write.text(path)
        parts.append(sources.in_list(p, sources.read_split_list(s, path)).groupBy("sex").agg(F.count("*").alias("n"), F.sum("study_id").alias("ids")).withColumn("list", F.lit(split)))
    return reduce(DataFrame.unionByName, parts)


def saved_splits(s, d) -> DataFrame:
    path = scratch(s, "saved_splits")
    sinks.write_splits(studies(s, d).select("study_id", "patient_id", "split"), path)
    return s.read.parquet(path).where("split <> 'train'").groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("patient_id").alias("patients"))


def saved_metadata(s, d) -> DataFrame:
    """Study metadata from a CSV with ages as text, of which some are none; studies that have a file, with its path."""
    path = scratch(s, "saved_metadata")
    age = F.when(F.col("study_id") % 5 == 0, F.concat("age", F.lit("Y"))).otherwise(F.col("age").cast("string"))
    rows = findings(s, d).select(F.concat("study_id", F.lit(".png")).alias("Image Index"), "finding_labels", F.lit(0).alias("follow_up"), "patient_id", age.alias("age"), "sex", F.lit("PA").alias("view"))
    rows.write.option("header", True).csv(path)
    meta = sources.read_metadata(s, path).withColumn("age", sources.parsed_age())
    files = meta.where("not endswith(image_id, '3.png')").select("image_id", F.concat(F.lit("/images/"), "image_id").alias("path"))
    return sources.with_files(meta, files).select("image_id", "finding_labels", "patient_id", "age", "sex", "path")


def wide_and_long(s, d) -> DataFrame:
    p = predictions(s, d).where("split = 'val'")
    wide = stage(sources.to_wide(p, ("run_id", "study_id")), "wide")
    return rounded(sources.to_long(wide).groupBy("run_id", "class_idx", "label").agg(F.count("*").alias("n"), F.sum("score").alias("score")), 5)


QUERIES = {
    "saved_predictions": saved_predictions,
    "saved_thresholds": saved_thresholds,
    "saved_results": saved_results,
    "saved_report": saved_report,
    "saved_table": saved_table,
    "saved_localization": saved_localization,
    "saved_boxes": saved_boxes,
    "saved_lists": saved_lists,
    "saved_splits": saved_splits,
    "saved_metadata": saved_metadata,
    "wide_and_long": wide_and_long,
    "member_violations": lambda s, d: sources.member_violations(flawed_predictions(s, d)),
    "patient_violations": lambda s, d: sources.patient_violations(flawed_predictions(s, d), studies(s, d).where("study_id % 23 > 0")),
}

_MACRO = f"{_V}, {_again('experiment, model, class_idx', 'test', 'r').replace(', 6)', ', 15)')}, m AS (SELECT experiment, model, avg(auroc) AS macro_auroc, avg(auprc) AS macro_auprc FROM r GROUP BY experiment, model)"
_FLAWED = f"""{_V}, f0 AS (SELECT run_id, study_id, class_idx, split, CASE WHEN run_id = 2 AND study_id % 13 = 0 THEN 1 - label ELSE label END AS label,
    CASE WHEN run_id = 3 AND study_id % 17 = 0 THEN -patient_id ELSE patient_id END AS patient_id FROM val WHERE NOT (run_id = 1 AND study_id % 11 = 0)),
  flawed AS (SELECT * FROM f0 UNION ALL SELECT * FROM f0 WHERE run_id = 4 AND study_id % 19 = 0)"""

ORACLE_SQL = {
    "saved_predictions": f"""{_V}, h AS (SELECT *, CASE WHEN experiment = 'exp_b' AND split = 'val' THEN score / 2 ELSE score END AS s FROM pred WHERE split IN ('val', 'test'))
SELECT experiment, model, split, class_idx, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(sum(s), 5) AS score, max(patient_id) AS last_patient FROM h GROUP BY experiment, model, split, class_idx""",
    "saved_thresholds": f"""{_V}, {_tuned('f1')} SELECT run_id, class_idx, round(threshold, 4) AS threshold, status, '{{"beta": 2, "objective": "f1"}}' AS settings FROM tuned""",
    "saved_results": f"""{_MACRO}, u AS (SELECT experiment, 'macro_auroc' AS metric, CASE WHEN experiment = 'exp_d' THEN 1.0::DOUBLE ELSE round(macro_auroc, 6) END AS value FROM m
  UNION ALL SELECT experiment, 'macro_auprc', CASE WHEN experiment <> 'exp_c' THEN round(macro_auprc, 6) END FROM m)
SELECT metric, {", ".join(f"max(CASE WHEN experiment = '{e}' THEN value END) AS {e}" for e in EXPERIMENTS)} FROM u GROUP BY metric""",
    "saved_report": f"""{_FIRED}, {_RATES}, n AS (SELECT DISTINCT run_id, experiment, model FROM pred)
SELECT experiment, model, class_idx, metric, value FROM (UNPIVOT (SELECT run_id, class_idx, precision, recall, f1 FROM full_rates) ON precision, recall, f1 INTO NAME metric VALUE value) JOIN n USING (run_id)""",
    "saved_table": f"{_MACRO} SELECT experiment, model, round(macro_auroc, 6) AS macro_auroc, round(macro_auprc, 6) AS macro_auprc FROM m",
    "saved_localization": f"""{_SCORED}, each AS (SELECT class_idx, avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END) AS pointing, avg(energy) AS energy, avg(area) AS baseline FROM scored GROUP BY class_idx)
SELECT 'exp_a' AS experiment, 'net_x' AS model, 'map' AS method, round(avg(pointing), 6) AS pointing_game, round(avg(energy), 6) AS energy_fraction, round(avg(baseline), 6) AS random_baseline FROM each""",
    "saved_boxes": """WITH b AS (SELECT vec_id, CASE label WHEN 0 THEN 'Infiltration' WHEN 1 THEN 'Elsewhere' ELSE 'class_' || label END AS finding, vec_id % 7 = 0 AS lost FROM embeddings)
SELECT finding, count(*) AS n, round(sum((vec_id % 5) * (4.0::DOUBLE / (8 + vec_id % 3))), 5) AS x, round(sum((vec_id % 4) * 0.25::DOUBLE), 5) AS y,
  round(sum((vec_id % 3 + 1) * (4.0::DOUBLE / (8 + vec_id % 3))), 5) AS w, round(sum((vec_id % 2 + 2) * 0.25::DOUBLE), 5) AS h FROM b WHERE finding <> 'Elsewhere' AND NOT lost GROUP BY finding
UNION ALL SELECT CASE WHEN finding = 'Elsewhere' THEN finding ELSE 'lost ' || finding END AS finding, count(*), NULL, NULL, NULL, NULL FROM b WHERE finding = 'Elsewhere' OR lost GROUP BY 1""",
    "saved_lists": f"{_STUDY} SELECT sex, count(*) AS n, CAST(sum(study_id) AS BIGINT) AS ids, split AS list FROM study WHERE split <> 'train' GROUP BY sex, split",
    "saved_splits": f"{_STUDY} SELECT split, count(*) AS n, count(DISTINCT patient_id) AS patients FROM study WHERE split <> 'train' GROUP BY split",
    "saved_metadata": f"""{_STUDY}, f AS (SELECT study_id, string_agg(finding, '|' ORDER BY finding) AS finding_labels FROM hit GROUP BY study_id)
SELECT study_id || '.png' AS image_id, coalesce(finding_labels, 'No Finding') AS finding_labels, CAST(patient_id AS VARCHAR) AS patient_id, CASE WHEN study_id % 5 > 0 THEN CAST(age AS DOUBLE) END AS age, sex,
  '/images/' || study_id || '.png' AS path FROM study LEFT JOIN f USING (study_id) WHERE study_id % 10 <> 3""",
    "wide_and_long": f"{_V} SELECT run_id, class_idx, label, count(*) AS n, round(sum(score), 5) AS score FROM val GROUP BY run_id, class_idx, label",
    "member_violations": f"""{_FLAWED}, c AS (SELECT split, study_id, class_idx, count(DISTINCT run_id) AS runs, count(*) AS rows, count(DISTINCT label) AS labels, count(DISTINCT patient_id) AS patients FROM flawed GROUP BY split, study_id, class_idx)
SELECT split, study_id, class_idx, CAST(runs AS INT) AS runs, rows, CAST(labels AS INT) AS labels, CAST(patients AS INT) AS patients FROM c WHERE runs < 5 OR rows > 5 OR labels <> 1 OR patients <> 1""",
    "patient_violations": f"""{_FLAWED}, p AS (SELECT DISTINCT study_id, patient_id AS own FROM flawed)
SELECT p.study_id, own, s.patient_id FROM p LEFT JOIN (SELECT * FROM study WHERE study_id % 23 > 0) s ON s.study_id = p.study_id WHERE own IS DISTINCT FROM s.patient_id""",
}
