"""Sweeps, ranks and quantiles over several ranges, large weights, and the parts of reports that files and models feed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkeval import ensemble, heatmaps, labels, metrics, ranking, reports, scoring, sources, splits, thresholds
from sparkeval.bridge import linear_model, vectors

PRED = "run_id int, study_id long, patient_id string, class_idx int, label int, score double"


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def pred(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k, (n, places) in enumerate(((3000, 3), (800, 1), (5, 9))):
        y = rng.random(n) < 0.3
        rows += [(0, i, f"p{i // 3}", k, int(a), float(np.round(0.3 * a + 0.7 * b, places))) for i, (a, b) in enumerate(zip(y, rng.random(n)))]
    return spark.createDataFrame(rows, PRED)


def test_sweep_over_ranges(spark, pred, many_ranges):
    got = {(r.class_idx, r.score): (r.tp, r.fp, r.fn, r.tn) for r in ranking.confusion_sweep(pred).collect()}
    data = {k: np.array([(r.label, r.score) for r in pred.where(f"class_idx = {k}").collect()]) for k in range(3)}
    want = {}
    for k, d in data.items():
        for t in np.unique(d[:, 1]):
            on = d[:, 1] >= t
            want[k, float(t)] = tuple(int(x) for x in ((on & (d[:, 0] == 1)).sum(), (on & (d[:, 0] == 0)).sum(), (~on & (d[:, 0] == 1)).sum(), (~on & (d[:, 0] == 0)).sum()))
    assert got == want
    for r in ranking.rank_metrics(pred).collect():
        d = data[r.class_idx]
        p, n = d[d[:, 0] == 1, 1], d[d[:, 0] == 0, 1]
        assert r.auroc == pytest.approx(((p[:, None] > n).sum() + (p[:, None] == n).sum() / 2) / (len(p) * len(n)))
    edges = metrics.score_quantiles(ranking.swept(ranking.score_counts(pred)), [i / 15 for i in range(16)], ("run_id", "class_idx"))
    for r in edges.collect():
        assert r.edges == pytest.approx(np.unique(np.quantile(data[r.class_idx][:, 1], np.arange(16) / 15)), abs=1e-12)


def test_places_over_ranges(spark, pred, many_ranges):
    got = {(r.class_idx, r.study_id): r.score for r in ensemble.rank_transform(pred).collect()}
    flags = {(r.class_idx, r.study_id) for r in ensemble.top_flags(pred).collect()}
    for k in range(3):
        rows = sorted((r.score, r.study_id) for r in pred.where(f"class_idx = {k}").collect())
        assert [got[k, i] for _, i in rows] == pytest.approx([j / (len(rows) - 1) for j in range(len(rows))])
        positives = pred.where(f"class_idx = {k} and label = 1").count()
        top = sorted(rows, key=lambda r: (-r[0], r[1]))[:positives]
        assert {i for c, i in flags if c == k} == {i for _, i in top}


def test_large_weights(spark):
    """Three thousand million weighted rows a class do not overflow."""
    rows = spark.createDataFrame([(0, 0, y, s, 3_000_000_000) for y, s in ((1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1))], "run_id int, class_idx int, label int, score double, weight long")
    r = ranking.rank_metrics(rows, weight="weight").first()
    assert r.auroc == 0.75 and r.n == 12_000_000_000 and r.auprc == pytest.approx((1 + 2 / 3) / 2)
    assert thresholds.tune(rows, weight="weight").first().status == "tuned"


def test_sensitivity_takes_specificity(spark):
    """A class that only reaches the target when everything is called is degenerate."""
    rows = spark.createDataFrame([(0, 0, int(i < 60), 0.3) for i in range(200)], "run_id int, class_idx int, label int, score double")
    r = thresholds.tune(rows, "sensitivity").first()
    assert (r.status, r.threshold, r.objective) == ("degenerate", 0.5, 0.0)


def test_string_ids_and_fallbacks(spark):
    rows = spark.createDataFrame([(i, f"{i // 2:03d}x", int(i % 3 == 0)) for i in range(100)], "study_id long, patient_id string, a int")
    folds = {r.patient_id: r.fold for r in labels.grouped_folds(rows, 5).collect()}
    assert len(folds) == 50 and sorted(np.bincount(list(folds.values()))) == [10] * 5
    alone = rows.drop("patient_id")
    assert sorted(np.bincount([r.fold for r in labels.grouped_folds(alone, 3).collect()])) == [33, 33, 34]
    split = splits.train_val_split(alone, None, ["a"], 0.25)
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 75, "val": 25}
    small, large = ({r.study_id for r in splits.nested_subset(alone, None, ["a"], n).collect()} for n in (10, 30))
    assert len(small) == 10 and len(large) == 30 and small < large
    assert labels.age_histogram(spark.createDataFrame([(5,), (5,)], "age int")).first().bin == 15


def test_reports_from_files(spark, tmp_path):
    t = spark.createDataFrame([(0, 0, 0.123456, "tuned")], "run_id int, class_idx int, threshold double, status string")
    from sparkeval import sinks

    sinks.write_thresholds(t, str(tmp_path / "t"), {"metric": "f1"})
    r = sources.read_thresholds(spark, str(tmp_path / "t")).first()
    assert r.threshold == 0.1235 and r.status == "tuned" and "f1" in r.settings
    images = spark.createDataFrame([(10, 20), (30, 20)], "width int, height int")
    assert tuple(sources.mean_image_size(images).first()) == (2, 20.0, 20.0)
    wide = spark.createDataFrame([(1, [0, 2], [1, 0], [0.5, 0.25])], "study_id long, classes array<int>, labels array<int>, scores array<double>")
    assert {tuple(r) for r in sources.to_long(wide).collect()} == {(1, 0, 1, 0.5), (1, 2, 0, 0.25)}
    ages = spark.createDataFrame([("058Y",), ("58.5",), (" 7 ",), ("x",), (None,)], "age string")
    assert [r[0] for r in ages.select(sources.parsed_age()).collect()] == [None, 58.5, 7.0, None, None]
    studies = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "image_id string, v int").coalesce(1)
    boxes = spark.createDataFrame([("a", 1.0), ("c", 2.0)], "image_id string, x double")
    found, lost = sources.annotated(boxes, studies)
    assert [(r.image_id, r.v) for r in found.collect()] == [("a", 1)] and [r.image_id for r in lost.collect()] == ["c"]


def test_ensembles_raise(spark):
    rows = [(r, e, m, s, i, f"p{i}", k, int((i + k) % 3 == 0), 0.5 + 0.1 * ((i + k) % 3 == 0) + (i * 7 + r) % 10 / 100) for r, e, m in ((0, "a", "x"), (1, "b", "y")) for s in ("val", "test") for i in range(200) for k in range(2)]
    p = spark.createDataFrame(rows, "run_id int, experiment string, model string, split string, study_id long, patient_id string, class_idx int, label int, score double")
    runs = p.select("run_id", "experiment", "model").distinct()
    out = {(r.section, r.metric): r.value for r in reports.ensemble_report(p, runs).where("class_idx is null").collect()}
    assert out["evaluation", "macro_auroc"] > 0.9 and ("diversity", "correlation") in out
    with pytest.raises(ValueError, match="two members"):
        reports.ensemble_report(p, runs, ensembles=spark.createDataFrame([("b", "y")], "experiment string, model string"))
    with pytest.raises(ValueError, match="differ"):
        reports.ensemble_report(p.where("NOT (run_id = 1 AND split = 'test' AND study_id = 3)"), runs)


def test_localization_against_loops(spark):
    """IoU and IoBB by method and where the class was called, on the vectors, against plain loops over the maps."""
    folder = "/root/testdata/sf0.001"
    from sparkeval.queries import localization

    scored = localization(spark, folder)
    rows = scored.collect()
    x = {r.image_id: np.array(r.features, float) for r in vectors(spark, folder).collect()}
    model = linear_model()()
    for r in rows[:200]:
        cells = np.array(r.cells).reshape(8, 8)
        b, truth = r.boxes[0], np.zeros((8, 8), bool)
        truth[int(b.y) : int(b.y + b.h), int(b.x) : int(b.x + b.w)] = True
        best, seen, on = [], set(), cells >= 0.5 * cells.max()
        for at in zip(*np.nonzero(on)) if cells.max() > 0 else ():
            look, blob = [at], []
            while look:
                p = look.pop()
                if p in seen or not (0 <= p[0] < 8 and 0 <= p[1] < 8) or not on[p]:
                    continue
                seen.add(p)
                blob.append(p)
                look += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
            best = blob if len(blob) > len(best) else best
        found = np.zeros((8, 8), bool)
        if best:
            ys, xs = zip(*best)
            found[min(ys) : max(ys) + 1, min(xs) : max(xs) + 1] = True
        both = (found & truth).sum()
        assert r.iou == pytest.approx(both / max((found | truth).sum(), 1)) and r.iobb == pytest.approx(both / max(found.sum(), 1))
        score = 1 / (1 + np.exp(-model(x[r.image_id][None])[0]))
        assert r.fired == (score[r.class_idx] >= 0.5)
        score[r.class_idx] = -1
        assert r.absent_class == score.argmax()
    got = {(r.method, r["where"]): r.iou for r in heatmaps.localization_report(scored).where("class_idx is null").collect()}
    each = {}
    for r in rows:
        each.setdefault((r.method, "all"), {}).setdefault(r.class_idx, []).append(r.iou)
        if r.fired:
            each.setdefault((r.method, "fired"), {}).setdefault(r.class_idx, []).append(r.iou)
    assert got == {k: pytest.approx(np.mean([np.mean(v) for v in by.values()])) for k, by in each.items()}


def test_scoring_nulls_and_empty(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "image_id long, features array<double>")
    out = scoring.score_rows(rows, lambda: lambda x: x @ np.eye(2), 2).collect()
    assert [(r.image_id, r.class_idx, r.logit) for r in out] == [(1, 0, 1.0), (1, 1, 2.0)]
    assert scoring.score_rows(rows.where("false"), lambda: lambda x: x, 2).count() == 0
