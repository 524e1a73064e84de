"""What keeps jobs from growing faster than their input: what is written once, added up before it is shuffled, or broadcast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkeval import bootstrap, bridge, ensemble, metrics, queries, ranking, reports, sources, splits, stacking, staging, subgroups
from sparkeval.bridge import laid_out, predictions, staged_predictions, staged_studies, studies

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_staged(df):
    return sum(df.sparkSession.read.parquet(f).count() for f in df.inputFiles())


def test_staged_predictions_write_a_row_a_study(spark):
    got, want = staged_predictions(spark, FOLDER, "split = 'val'"), predictions(spark, FOLDER).where("split = 'val'")
    assert got.dtypes == want.dtypes and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert rows_staged(got) == studies(spark, FOLDER).where("split = 'val'").count()


def test_thresholds_and_weights_are_broadcast(spark):
    _, _, fired = queries._tuned_and_fired(spark, FOLDER)
    assert rows_staged(fired) < 2 * studies(spark, FOLDER).count()  # studies and thresholds, no predictions
    assert "SortMergeJoin" not in plan(queries.weighted_bce(spark, FOLDER)) and "Exchange hashpartitioning(class_idx" not in plan(queries.weighted_bce(spark, FOLDER))


def test_studies_by_level_are_not_sorted(spark):
    fired = queries._fired(spark, FOLDER)
    assert "SortAggregate" not in plan(subgroups.by_study(fired)) and "ObjectHashAggregate" not in plan(subgroups.by_study(fired))
    counts = plan(subgroups.level_counts(fired))
    assert counts.index("Generate") < counts.rindex("HashAggregate")  # rows are counted below it, so before they are laid out by axis


def test_level_counts_equal_those_of_rows(spark):
    fired = queries._fired(spark, FOLDER)
    at = ["run_id", "axis", "level", "class_idx", "score"]
    want = subgroups.by_level(fired).groupBy(*at).agg(F.sum("label").alias("pos"), F.count("*").alias("n"), F.sum(F.col("fired") * F.col("label")).alias("hits"))
    got = subgroups.level_counts(fired)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < got.count()


def test_folds_read_a_written_patient_table(spark):
    folds = splits.stratified_folds(queries._patients(spark, FOLDER), [c.lower() for c in queries.CLASSES], [0.7, 0.3])
    assert folds.inputFiles() and all("split_patients" in f for f in folds.inputFiles())


def test_parts_of_an_order_follow_its_rows(spark, monkeypatch):
    monkeypatch.setattr(staging, "RANGE_ROWS", 50)
    placed = staging.numbered(spark.range(2000).select((F.col("id") * 7 % 2000).alias("v")), (), ["v"], "many_parts")
    assert [r.place for r in placed.orderBy("v").collect()] == list(range(2000))
    assert spark.read.parquet(*[f for f in placed.inputFiles() if "many_parts-" in f]).groupBy("part").count().agg(F.max("count")).first()[0] < 200


def test_top_flags_order_only_the_last_score(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(r, c, s, int(rng.random() < 0.3), float(rng.integers(0, 12)) / 12) for r in range(2) for c in range(3) for s in range(200)]
    rows += [(0, 9, s, 0, 0.5) for s in range(5)] + [(1, 9, s, 1, 0.5) for s in range(5)] + [(0, 8, s, 1, None if s < 2 else 0.1) for s in range(4)]
    pred, numbered = spark.createDataFrame(rows, "run_id int, class_idx int, study_id long, label int, score double"), []
    monkeypatch.setattr(ensemble, "numbered", lambda df, *a: numbered.append(df.count()) or staging.numbered(df, *a))
    got = {(r.run_id, r.class_idx, r.study_id, r.k) for r in ensemble.top_flags(pred).collect()}
    want = set()
    for key in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == key), key=lambda r: (r[4] is None, -(r[4] or 0), r[2]))
        k = sum(r[3] for r in own)
        want |= {(*r[:3], k) for r in own[:k]}
    assert got == want and numbered[0] < len(rows) / 4


def test_newton_sums_of_all_models_in_one_pass(spark):
    rng = np.random.default_rng(5)
    x, y, fold = np.c_[np.ones(300), rng.normal(size=(300, 2))], rng.integers(0, 2, 300), rng.integers(0, 3, 300)
    rows = [(0, int(f), int(v), r.tolist()) for r, v, f in zip(x, y, fold)] + [(0, 0, 1, [1.0, 2.0]), (0, 1, 1, [1.0, None, 2.0])]
    w = {(0, -1): rng.normal(size=3), (0, 1): rng.normal(size=3)}
    out = spark.createDataFrame(rows, "class_idx int, fold int, label int, x array<double>").mapInArrow(stacking._newton_sums(w, 3), stacking.SUMS).collect()
    for (k, f), c in w.items():
        own, p = fold != f, 1 / (1 + np.exp(-(x @ c)))
        g, h = (np.sum([r[name] for r in out if r.fold == f], axis=0) for name in ("g", "h"))
        assert np.allclose(g, x[own].T @ (p - y)[own]) and np.allclose(h.reshape(3, 3), (x * (p * (1 - p))[:, None])[own].T @ x[own])


def test_draws_shuffle_sums_of_patients_and_rows_once(spark):
    fired = queries._fired(spark, FOLDER)
    slots = bootstrap.numbered(fired)
    assert "HashAggregate" not in plan(bootstrap._packed(fired, slots, ("run_id", "class_idx")))
    twice = fired.unionByName(fired)  # a patient with a score several times
    once, both = (bootstrap.bootstrap_rank(f, 20, ("run_id", "class_idx")).orderBy("draw", "run_id", "class_idx").toPandas() for f in (fired, twice))
    assert np.allclose(once.auroc, both.auroc, equal_nan=True) and len(once)


def test_rates_add_up_patients_before_they_meet_slots(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(bootstrap, "sums_over_draws", lambda per, *a: seen.append(plan(per)) or (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        bootstrap.bootstrap_rates(queries._fired(spark, FOLDER), 10)
    assert seen[0].index("slot") < seen[0].index("HashAggregate")  # the join is above


def test_members_that_agree_need_no_sets(spark):
    p = predictions(spark, FOLDER).where("split = 'val'").select("run_id", "split", "study_id", "patient_id", "class_idx", "label", "score")
    good = sources.member_violations(p)
    assert any("odd_cells" in f for f in good.inputFiles()) and good.count() == 0
    bad = p.where("NOT (run_id = 1 AND study_id % 11 = 0)").unionByName(p.where("run_id = 4 AND study_id % 19 = 0")).withColumn("label", F.when(F.expr("run_id = 2 AND study_id % 13 = 0"), 1 - F.col("label")).otherwise(F.col("label")))
    bad = bad.where("NOT (run_id = 0 AND study_id % 23 = 0)").unionByName(p.where("run_id = 3 AND study_id % 23 = 0"))  # as many rows as runs, one run twice
    want = bad.groupBy("study_id", "class_idx").agg(F.count_distinct("run_id").alias("r"), F.count("*").alias("n"), F.count_distinct("label").alias("l")).where("r < 5 OR n > 5 OR l <> 1")
    assert sources.member_violations(bad).count() == want.count() > 0


def test_report_takes_studies_together(spark, monkeypatch):
    """A study's rows are dealt before classes and runs are laid out, and meet no shuffle of their own; scores are not collected; images are read from the same sums."""
    staged = {}
    monkeypatch.setattr(bridge, "STUDIES_A_FILE", 200)
    monkeypatch.setattr(reports, "stage", lambda df, name: staged.setdefault(name, plan(df)) and staging.stage(df, name))
    queries.QUERIES["evaluation_metrics"](spark, FOLDER)
    p = staged["report_studies"]
    assert p.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(study_id" in p and "ObjectHashAggregate" not in p and "SortAggregate" not in p
    seen, parts = staged_studies(spark, FOLDER, "split = 'test'")
    a, b = laid_out(seen), laid_out(seen.repartition(parts, "study_id"))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 < a.count()


def test_noisy_or_by_columns_equals_that_of_lists(spark):
    rng = np.random.default_rng(4)
    rows = [(s, k, float(rng.random())) for s in range(200) for k in (7, 0, 3, 12) if rng.random() < 0.8]
    rows += [(900, 0, None), (900, 3, 0.5), (901, 0, 0.25), (901, 0, 0.5), (902, None, 0.1), (902, 7, 0.2), (903, 7, None)]
    r = spark.createDataFrame(rows, "study_id long, class_idx int, score double").groupBy("study_id")
    got, want = ({x.study_id: x[1:] for x in r.agg(*metrics.screening_scores(c)).collect()} for c in ([7, None, 12, 0, 3], None))
    assert got == want


def test_equal_scores_meet_in_their_range(spark):
    """Rows of a score in several batches and ranges are one step of the sweep, whatever null and NaN are among them, and the sweep is read without a shuffle."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = np.random.default_rng(6)
        rows = [(r, k, s, int(rng.integers(0, 3)), int(rng.integers(3, 9))) for r in (0, 1, None) for k in (None, 2) for s in (0.25, None, float("nan"), -0.0, 0.0, 0.5, 0.75) for _ in range(int(rng.integers(1, 30)))]
        d = spark.createDataFrame(rows, "run_id int, class_idx int, score double, pos long, n long")
        got = ranking.swept(d, repeated=True, parts=5)
        assert "Window" not in plan(got) and "Exchange hashpartitioning" not in plan(got)
        whole = d.groupBy("run_id", "class_idx", "score").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
        at = lambda r: (str(r.run_id), str(r.class_idx), "0.0" if r.score == 0 else str(r.score))
        result = {at(r): (r.pos, r.n, r.tp, r.fp, r.p, r.total) for r in got.collect()}
        want, place = {}, {"nan": 4, "0.75": 3, "0.5": 2, "0.25": 1, "0.0": 0, "None": -1}
        steps = {at(r): (r.pos, r.n) for r in whole.collect()}
        for (a, b, s), (pos, n) in steps.items():
            up = [v for (x, y, z), v in steps.items() if (x, y) == (a, b) and place[z] >= place[s]]
            own = [v for (x, y, _), v in steps.items() if (x, y) == (a, b)]
            tp, called = (sum(v[i] for v in up) for i in (0, 1))
            want[a, b, s] = (pos, n, tp, called - tp, sum(v[0] for v in own), sum(v[1] for v in own))
        assert result == want and got.count() == len(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
