"""Predictions laid out after the joins of studies, against the plain SQL."""

from sparkeval.bridge import bridge, cell_labels, predictions

FOLDER = "/root/testdata/sf0.001"


def test_predictions_equal_the_sql(spark):
    got, want = predictions(spark, FOLDER), bridge(spark, FOLDER, "SELECT * FROM pred")
    assert got.dtypes == want.dtypes and got.count() == want.count() > 0
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    cells, plain = cell_labels(spark, FOLDER), want.select("split", "study_id", "class_idx", "label").distinct()
    assert cells.dtypes == plain.dtypes and cells.exceptAll(plain).count() == plain.exceptAll(cells).count() == 0


def test_findings_join_before_classes_and_runs(spark):
    """What is joined and shuffled is a row a study."""
    plan = predictions(spark, FOLDER).where("split = 'test'")._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex(", Cross") < plan.index("LeftOuter")
