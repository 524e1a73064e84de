"""Whole evaluations as one call each, in tidy tables: a run's report, threshold analysis, subgroup report and comparison, ensembles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeval import bootstrap, ensemble, metrics, ranking, sources, subgroups, thresholds
from sparkeval.ranking import rank_metrics
from sparkeval.labels import counted
from sparkeval.staging import RANGE_ROWS, checked, same_keys, stage

SCREENS = ("max", "noisy_or")
KINDS = ("class", "micro", *SCREENS)
GAPS = ("auroc", "fnr", "underdiagnosis")


def _tidy(table: DataFrame, scope: str, names: Sequence[str]) -> DataFrame:
    """run_id, scope, class_idx (null outside `class`), metric and value."""
    klass = F.col("class_idx").cast("int") if scope == "class" else F.lit(None).cast("int")
    t = table.select("run_id", klass.alias("class_idx"), *[F.col(c).cast("double").alias(c) for c in names])
    return t.unpivot(["run_id", "class_idx"], list(names), "metric", "value").withColumn("scope", F.lit(scope))


def report_counts(fired: DataFrame, together: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All that a report reads of its rows, as three tables.

    run_id, kind (a place in KINDS), class_idx (null but for classes), score, pos and n: positives and rows at each score of each class, of all cells together (micro),
    and of studies by their highest score and by noisy-or, which may have a score in several rows; one sweep over it gives all rank metrics.
    run_id, kind, class_idx, tp and called, of classes and micro. A staged row for each run and study with its sums and scores.
    """
    count = [F.sum("label").cast("long").alias("pos"), F.count("*").alias("n")]
    calls = [F.sum(F.col("fired") * F.col("label")).cast("long").alias("tp"), F.sum("fired").cast("long").alias("called")]
    c = stage(fired.groupBy("run_id", "class_idx", "score").agg(*count, *calls), "report_class_counts")
    classes = [r.class_idx for r in c.select("class_idx").distinct().limit(metrics.PRODUCT_CLASSES + 1).collect()]
    sums = [*metrics.image_sums(), F.max("label").alias("label"), *metrics.screening_scores(classes)]
    i = stage((fired if together is None else together).groupBy("run_id", "study_id").agg(*sums).drop("study_id"), "report_studies")

    def kind(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        klass = F.col("class_idx") if name == "class" else F.lit(None).cast(c.schema["class_idx"].dataType)
        return rows.select("run_id", F.lit(KINDS.index(name)).alias("kind"), klass.alias("class_idx"), *columns)

    step = ("score", "pos", "n")
    whole = kind(c.groupBy("run_id", "score").agg(*[F.sum(x).alias(x) for x in step[1:]]), "micro", *step)
    highest = kind(i.groupBy("run_id", F.col("max").alias("score")).agg(*count), "max", *step)
    # few studies share a noisy-or, so they are not counted before they meet in their range
    other = kind(i.select("run_id", F.col("noisy_or").alias("score"), F.col("label").cast("long").alias("pos"), F.lit(1).cast("long").alias("n")), "noisy_or", *step)
    called = stage(c.groupBy("run_id", "class_idx").agg(*[F.sum(x).alias(x) for x in ("tp", "called")]), "report_calls")
    called = kind(called, "class", "tp", "called").unionByName(kind(called.groupBy("run_id").agg(*[F.sum(x).alias(x) for x in ("tp", "called")]), "micro", "tp", "called"))
    return kind(c, "class", *step).unionByName(stage(whole.unionByName(highest), "report_counts")).unionByName(other), called, i


def evaluation_report(fired: DataFrame, tuned: DataFrame, draws: int = 0, bins: int = 15, strategy: str = "quantile", together: DataFrame | None = None, slots: DataFrame | None = None) -> DataFrame:
    """run_id, scope, class_idx, metric, value, ci_low, ci_high and, for thresholds, their status as `note`.

    Scopes: class, macro, micro, screening (normal against abnormal). Intervals, with draws, are those of AUROC, average precision,
    precision, recall and F1, by class and macro. fired: predictions with `fired`, read several times, so staged by the caller if they are dear; tuned: thresholds of
    run_id and class_idx; together: the rows of fired, dealt over tasks by study_id, if the caller can do so before classes and runs are laid out; slots: as in bootstrap_rank.
    """
    counts, called, studies = report_counts(fired, together)
    parts = counts.count() // RANGE_ROWS + 1
    more = parts > int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ("run_id", "kind", "class_idx")
    s = ranking.swept(counts, keys, parts=parts if more else None, repeated=True)
    square = F.sum(F.col("pos") * (F.col("score") - 1) ** 2 + (F.col("n") - F.col("pos")) * F.col("score") ** 2) / F.sum("n")
    g = same_keys(s.groupBy(*keys).agg(*ranking.rank_sums(), square.alias("brier")), called, keys, "left")
    ratio, sides = thresholds.safe_ratio, F.col("called") + F.col("support")
    rates = {"precision": ratio(F.col("tp"), F.col("called")), "recall": ratio(F.col("tp"), F.col("support")), "f1": ratio(2 * F.col("tp"), sides), "prevalence": F.col("support") / F.col("n")}
    g = stage(g.withColumns(rates), "report_items")
    of_class, pair = F.col("kind") == KINDS.index("class"), ("run_id", "class_idx")
    ece = metrics.calibration_error(s.where(of_class).drop("kind"), bins, strategy, pair)
    c = same_keys(g.where(of_class), ece, pair)
    c = stage(c.join(tuned.select(*pair, "threshold", "status"), list(pair), "left"), "report_classes")
    names = ["threshold", "auroc", "auprc", "precision", "recall", "f1", "brier", "ece", "support", "prevalence"]
    means = c.groupBy("run_id").agg(*[F.avg(x).alias(x) for x in names[1:8]])
    images = studies.groupBy("run_id").agg(*metrics.image_means())
    images = images.withColumn("sample_accuracy_none", 1 - F.col("hamming_loss_none")).drop("hamming_loss_none")
    screened = g.withColumn("item", F.array(*[F.lit(k) for k in KINDS])[F.col("kind")]).where(F.col("item").isin(*SCREENS))
    screened = screened.unpivot(["run_id", "item"], ["auroc", "auprc", "prevalence"], "m", "value")
    screened = screened.select("run_id", F.lit(None).cast("int").alias("class_idx"), F.concat_ws("_", "item", "m").alias("metric"), "value", F.lit("screening").alias("scope"))
    parts = [
        _tidy(c, "class", names), _tidy(means, "macro", names[1:8]), _tidy(images, "macro", [x for x in images.columns if x != "run_id"]),
        _tidy(g.where(F.col("kind") == KINDS.index("micro")), "micro", ["auprc", "precision", "recall", "f1"]), screened,
    ]
    out = reduce(DataFrame.unionByName, parts)
    status = c.select("run_id", "class_idx", F.lit("threshold").alias("metric"), F.lit("class").alias("scope"), F.col("status").alias("note"))
    at = ["run_id", "class_idx", "metric", "scope"]
    out = same_keys(out, status, at, "left")
    if draws:
        ci = bootstrap.metric_intervals(bootstrap.bootstrap_rank(fired, draws, slots=slots), bootstrap.bootstrap_rates(fired, draws, slots=slots), draws)
        ci = ci.withColumn("scope", F.when(F.col("class_idx").isNull(), "macro").otherwise("class"))
        return same_keys(out, ci, at, "left")
    none = F.lit(None).cast("double")
    return out.withColumns({"ci_low": none, "ci_high": none})


def threshold_report(val: DataFrame, test: DataFrame, objective: str = "f1", draws: int = 1000) -> DataFrame:
    """A row for each run and class: the threshold of `objective` with its interval and its value's, and rates on test with intervals.

    Thresholds are refitted on each draw of validation patients; test rates are drawn at the frozen threshold.
    """
    keys = ["run_id", "class_idx"]
    tuned = stage(thresholds.tune(val, objective), "scheme_thresholds")
    fired = thresholds.apply_thresholds(test, tuned)
    refits = stage(bootstrap.bootstrap_thresholds(val, objective, draws), "scheme_refits")
    rates = stage(bootstrap.bootstrap_rates(fired, draws), "scheme_rates")
    out = tuned.join(thresholds.class_rates(fired).select(*keys, F.col("support").alias("test_support"), *[F.col(m).alias(f"test_{m}") for m in ("precision", "recall", "f1")]), keys)
    for source, column, name in [(refits, "threshold", "threshold"), (refits, "objective", "objective"), *[(rates, m, f"test_{m}") for m in ("precision", "recall", "f1")]]:
        ci = bootstrap.percentile_interval(source, column, tuple(keys), draws)
        out = out.join(ci.withColumnsRenamed({"ci_low": f"{name}_low", "ci_high": f"{name}_high"}), keys, "left")
    return out


def overall_rates(fired: DataFrame) -> DataFrame:
    """AUROC and miss rate, macro over all classes, and underdiagnosis of each run."""
    keys = ("run_id", "class_idx")
    fnr = fired.groupBy(*keys).agg((1 - thresholds.safe_ratio(F.sum(F.col("fired") * F.col("label")), F.sum("label"))).alias("fnr"), F.sum("label").alias("pos"))
    c = rank_metrics(fired).select(*keys, "auroc").join(fnr, list(keys))
    under = subgroups.abnormal_studies(fired).groupBy("run_id").agg(F.avg((F.col("fired") == 0).cast("double")).alias("underdiagnosis"))
    return c.groupBy("run_id").agg(F.avg("auroc").alias("auroc"), F.avg(F.when(F.col("pos") > 0, F.col("fnr"))).alias("fnr")).join(under, "run_id", "left")


def subgroup_report(fired: DataFrame, draws: int = 0, least: int = 10, slots: DataFrame | None = None) -> DataFrame:
    """A row for each run, axis and level: studies, patients, positives, classes scored, the rates, their gaps to the reference, intervals.

    AUROC and miss rate are means over the classes with enough positives in level and reference; without draws intervals are null. fired is read several times. slots: as in bootstrap_rank.
    """
    at = ["run_id", "axis", "level"]
    per = stage(subgroups.by_study(fired), "subgroup_studies")
    counts = counted(subgroups.by_level(per).groupBy(*at, "patient_id", "study_id").agg(F.sum("positives").alias("positives")), at, "positives")
    rates = subgroups.subgroup_gaps(fired, least).drop("ref_auroc", "ref_fnr")
    under = stage(subgroups.underdiagnosis(fired, per).drop("abnormal"), "subgroup_under")
    reference = F.when(F.col("axis") == "sex", subgroups.REFERENCE["sex"]).otherwise(subgroups.REFERENCE["age"])
    against = under.where(F.col("level") == reference).select("run_id", "axis", F.col("underdiagnosis").alias("ref"))
    under = under.join(against, ["run_id", "axis"], "left").withColumn("underdiagnosis_gap", F.col("underdiagnosis") - F.col("ref")).drop("ref")
    out = counts.join(rates, at, "left").join(under, at, "left").withColumn("classes", F.coalesce("classes", F.lit(0)))
    empty = F.lit(None).cast("double")
    if not draws:
        return out.withColumns({f"{m}_{e}": empty for m in GAPS for e in ("low", "high")} | {f"{m}_resolved": F.lit(False) for m in GAPS})
    ci = bootstrap.gap_intervals(bootstrap.bootstrap_gaps(fired, draws, least, slots=slots), draws).withColumn("metric", F.regexp_replace("metric", "_gap$", ""))
    cells = [F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{e}") for m in GAPS for c, e in (("ci_low", "low"), ("ci_high", "high"), ("resolved", "resolved"))]
    out = out.join(ci.groupBy(*at).agg(*cells), at, "left")
    return out.withColumns({f"{m}_resolved": F.coalesce(f"{m}_resolved", F.lit(False)) for m in GAPS})


def unassigned_ages(studies: DataFrame) -> DataFrame:
    """Studies, and those whose age lies in no band."""
    return studies.agg(F.count("*").alias("n"), F.count_if(subgroups.age_band().isNull()).alias("unassigned"))


def bias_comparison(overall: DataFrame, report: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """A row for each run, the highest AUROC first: overall rates, and gap and resolved flag of each axis, level (but the reference) and metric."""
    cells = []
    for axis, names in levels.items():
        for level in names:
            if level != subgroups.REFERENCE[axis]:
                own = (F.col("axis") == axis) & (F.col("level") == level)
                for m in GAPS:
                    name = f"{axis}_{level}_{m}".replace("-", "_")
                    cells += [F.max(F.when(own, F.col(f"{m}_gap"))).alias(f"{name}_gap"), F.coalesce(F.max(F.when(own, F.col(f"{m}_resolved"))), F.lit(False)).alias(f"{name}_resolved")]
    return overall.join(report.groupBy("run_id").agg(*cells), "run_id", "left").orderBy(F.desc("auroc"), "run_id")


def ensemble_report(pred: DataFrame, runs: DataFrame, rule: str = "mean", floor: float = 0.75, draws: int = 0, ensembles: DataFrame | None = None, slots: DataFrame | None = None) -> DataFrame:
    """section, run_id, class_idx, metric, value, ci_low, ci_high and note of a whole ensemble.

    pred names run_id, experiment and model; runs: run_id, experiment, model. Members are the best run of each model above the floor among runs with both splits that are no ensembles
    themselves; fewer than two raise, and so do members that differ in rows, labels or patients. They are combined by mean, logit, rank or
    stack, calibrated on validation, scored on test, and with draws compared with the member that is best on validation. slots: as in bootstrap_rank, of the test patients.
    Sections: member, diversity, evaluation, delta.
    """
    spark = pred.sparkSession
    if ensembles is None:
        ensembles = spark.createDataFrame([], "experiment string, model string")
    usable = runs.join(ensemble.discover_runs(pred, ensembles), ["experiment", "model"], "left_semi")
    pred = pred.join(checked(usable.select("run_id"), "usable_runs"), "run_id", "left_semi")  # a row for each run
    scan = [r for r in ensemble.select_members(pred, usable).collect() if r.status == "selected" and r.macro_auroc >= floor]  # a row for each run
    if len(scan) < 2:
        raise ValueError(f"an ensemble needs two members or more, not {len(scan)}")
    members = pred.where(F.col("run_id").isin([r.run_id for r in scan]))
    sources.check_members(members)
    val, test = members.where("split = 'val'"), members.where("split = 'test'")
    if rule == "stack":
        from sparkeval.stacking import stacked_predictions

        columns = ("study_id", "patient_id", "class_idx", "label", "score")
        mixed_val, mixed_test, _ = stacked_predictions(val, test, len(scan))
        mixed_val, mixed_test = mixed_val.select(*columns), mixed_test.select(*columns)
    else:
        mixed_val, mixed_test = ensemble.combine(val, rule), ensemble.combine(test, rule)
    mixed_val, mixed_test = (stage(m.withColumn("run_id", F.lit(-1)), "ensemble_scores") for m in (mixed_val, mixed_test))
    tuned = stage(thresholds.tune(mixed_val), "ensemble_thresholds")
    slots = slots if "slot" in mixed_test.columns else None
    report = evaluation_report(thresholds.apply_thresholds(mixed_test, tuned), tuned, draws, slots=slots)
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    stats = ensemble.run_auroc(members).select("run_id", F.concat("split", F.lit("_auroc")).alias("metric"), F.col("macro_auroc").alias("value"))
    stats = stats.select(F.lit("member").alias("section"), "run_id", F.lit(None).cast("int").alias("class_idx"), "metric", "value", none.alias("ci_low"), none.alias("ci_high"), text.alias("note"))
    means = ensemble.diversity_means(ensemble.diversity_table(val)).unpivot([], ["correlation", "disagreement"], "metric", "value")
    means = means.select(F.lit("diversity").alias("section"), F.lit(-1).alias("run_id"), F.lit(None).cast("int").alias("class_idx"), "metric", "value", none.alias("ci_low"), none.alias("ci_high"), text.alias("note"))
    own = report.select(F.lit("evaluation").alias("section"), "run_id", "class_idx", F.concat_ws("_", "scope", "metric").alias("metric"), "value", "ci_low", "ci_high", "note")
    out = stats.unionByName(means).unionByName(own)
    if draws:
        best = max(scan, key=lambda r: (r.macro_auroc, -r.run_id))
        delta = bootstrap.paired_delta(mixed_test, test.where(F.col("run_id") == best.run_id), draws, slots=slots)
        note = F.concat(F.lit(f"over {best.experiment}:{best.model}, share above 0 "), F.round("share_above", 6).cast("string"))
        delta = delta.select(F.lit("delta").alias("section"), F.lit(-1).alias("run_id"), F.lit(None).cast("int").alias("class_idx"), "metric", F.col("delta").alias("value"), "ci_low", "ci_high", note.alias("note"))
        out = out.unionByName(delta)
    return out
