import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from sparkeval import ensemble, labels, reports, runs, sinks, sources

CELLS = "experiment string, model string, split string, run_id int, study_id long, patient_id long, class_idx int, label int, score double"


def png(path, width, height, value):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + bytes([value]) * width for _ in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def pred(spark):
    rows = [(f"e{r}", "m", s, r, i, i // 2, k, (i + k) % 2, 0.1 * i + 1e-17 * k + 0.3) for r in range(2) for s in ("val", "test") for i in range(4) for k in range(2)]
    return spark.createDataFrame(rows, CELLS)


def test_metadata_lists_and_files(spark, tmp_path):
    (tmp_path / "meta.csv").write_text("Image Index,Finding Labels,Follow-up,Patient ID,Age,Sex,View\n1.png,A|B,0,007,058Y,M,PA\n2.png,No Finding,0,8,x,F,PA\n9.png,A,0,8,40,F,PA\n")
    (tmp_path / "list.txt").write_text(" 1.png \n\n2.png\n1.png\n")
    for folder in ("one", "two"):
        (tmp_path / folder / "in").mkdir(parents=True)
        png(tmp_path / folder / "in" / "1.png", 4, 3, 10)
    png(tmp_path / "one" / "2.png", 2, 2, 255)
    (tmp_path / "one" / "._2.png").write_bytes(b"sidecar")
    meta = sources.read_metadata(spark, str(tmp_path / "meta.csv"))
    got = meta.select("image_id", "patient_id", sources.parsed_age().alias("age")).orderBy("image_id").collect()
    assert [tuple(r) for r in got] == [("1.png", "007", None), ("2.png", "8", None), ("9.png", "8", 40)]
    assert {r.image_id for r in sources.in_list(meta, sources.read_split_list(spark, str(tmp_path / "list.txt"))).collect()} == {"1.png", "2.png"}
    index = sources.image_index(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    paths = {r.image_id: r.path for r in index.collect()}
    assert sorted(paths) == ["1.png", "2.png"] and "/two/" in paths["1.png"]
    assert sources.with_files(meta, index).count() == 2
    with pytest.raises(ValueError, match="have a file"):
        sources.with_files(meta, index, 0.9)
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        sources.image_index(spark, [str(tmp_path / "empty")])
    images = sources.read_images(spark, str(tmp_path / "one"))
    assert sorted((r.width, r.height) for r in images.collect()) == [(2, 2), (4, 3)]
    assert {r.bin: r.n for r in sources.pixel_histogram(images).collect()} == {1: 12, 49: 4}


def test_boxes(spark, tmp_path):
    (tmp_path / "boxes.csv").write_text("Image Index,Finding Label,Bbox [x,y,w,h],,,\n1.png,Infiltrate,1,2,3,4\n2.png,Other,1,1,1,1\n3.png,Mass,8,8,4,4\n".replace("Bbox [x,y,w,h],,,", "x,y,w,h,Unnamed: 6"))
    known, dropped = sources.read_boxes(spark, str(tmp_path / "boxes.csv"), ["Infiltration", "Mass"])
    assert [tuple(r) for r in known.orderBy("image_id").collect()] == [("1.png", "Infiltration", 1.0, 2.0, 3.0, 4.0), ("3.png", "Mass", 8.0, 8.0, 4.0, 4.0)]
    assert [tuple(r) for r in dropped.collect()] == [("Other", 1)]
    studies = spark.createDataFrame([("1.png", 16, 8), ("1.png", 16, 8)], "image_id string, image_width int, image_height int")
    pairs, lost = sources.annotated(known, studies)
    r = sources.scale_boxes(pairs, 8, 8).first()
    assert pairs.count() == 1 and lost.count() == 1 and (r.x, r.y, r.w, r.h) == (0.5, 2.0, 1.5, 4.0)


def test_predictions_round_trip(spark, pred, tmp_path):
    path = str(tmp_path / "pred")
    sinks.write_predictions(pred, path, enabled=False)
    assert not (tmp_path / "pred").exists()
    sinks.write_predictions(pred, path)
    sinks.write_predictions(pred.where("run_id = 1 and split = 'val'"), path)  # leaves the others
    got = sources.read_predictions(spark, path, "e0", "m", "val").select(pred.columns)
    want = pred.where("run_id = 0 and split = 'val'")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    wide = sources.to_wide(want)
    assert sources.to_long(wide).join(want, ["study_id", "class_idx", "label", "score"]).count() == want.count() == 2 * wide.count()
    with pytest.raises(FileNotFoundError):
        sources.read_predictions(spark, path, "e0", "m", "train")


def test_members_must_agree(pred):
    sources.check_members(pred)
    for bad in (pred.where("not (run_id = 1 and study_id = 2)"), pred.unionByName(pred.limit(1)), pred.withColumn("patient_id", F.col("run_id"))):
        with pytest.raises(ValueError, match="runs differ"):
            sources.check_members(bad)
    with pytest.raises(ValueError, match="another patient"):
        sources.check_patients(pred, pred.select("study_id", F.lit(0).alias("patient_id")))
    assert sources.parse_member("a : b") == ("a", "b")
    for spec in ("a", "a:", ":b", "a:b:c"):
        with pytest.raises(ValueError):
            sources.parse_member(spec)


def test_results_of_different_runs(spark, tmp_path):
    """Runs with other fields, an integer for a fraction, and a broken file; written equals read."""
    for e, doc in (("x", {"auroc": 1, "per": {"a": 1}}), ("y", {"auroc": 2.5, "other": [1, 2]}), ("z", {"auroc": "none", "per": 3})):
        (tmp_path / "in" / e / "results").mkdir(parents=True)
        (tmp_path / "in" / e / "results" / "net_results.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "in" / "w" / "results").mkdir(parents=True)
    (tmp_path / "in" / "w" / "results" / "net_results.json").write_text('{"auroc": ')
    for path in (tmp_path / "in", tmp_path / "in" / "*" / "results" / "*_results.json"):
        with pytest.warns(UserWarning, match="1 results are no JSON.*w/results"):
            got = sources.read_results(spark, str(path), {"auroc": "double", "per.a": "int", "other": "array<int>"}).orderBy("experiment").collect()
        assert [(r.experiment, r.model, r.auroc, r.per_a, r.other) for r in got] == [("x", "net", 1.0, 1, None), ("y", "net", 2.5, None, [1, 2]), ("z", "net", None, None, None)]


def test_written_results_are_read(spark, tmp_path):
    rows = [(f"exp {e}+%", f"net_{m}", e * 10 + k, f"m{k}", (e + 0.1) / (k + 3) if k else None) for e in range(3) for m in ("a", "b") for k in range(4)]
    report = spark.createDataFrame(rows, "experiment string, model string, place int, metric string, value double")
    sinks.write_report(report, str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("*/results/*_results.json"))) == 6
    got = sources.report_rows(spark, str(tmp_path / "r"), "place int, metric string, value double")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    sinks.write_report(report.where("experiment like '%1%'").withColumn("value", F.lit(1.0)), str(tmp_path / "r"))  # replaces its runs only
    again = sources.report_rows(spark, str(tmp_path / "r"), "place int, metric string, value double")
    assert again.where("value = 1").count() == 8 and again.count() == 24
    one = report.where("place % 10 = 1").select("experiment", "model", "value", F.struct(F.lit(1).alias("a"), F.array(F.lit(2.5)).alias("b")).alias("nested"))
    sinks.write_results(one, str(tmp_path / "s"))
    back = sources.read_results(spark, str(tmp_path / "s"), {"value": "double", "nested": "struct<a int, b array<double>>"}).drop("doc")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, one.collect()))
    for bad in (report, one.withColumn("model", F.lit(None).cast("string"))):
        with pytest.raises(ValueError, match="results of the run"):
            sinks.write_results(bad, str(tmp_path / "t"))


def test_comparisons_over_written_results(spark, tmp_path):
    """Tables over runs from the library's own files: metrics by run, localization, bias."""
    fields = "experiment string, model string, method string, macro struct<pointing_game: double, energy_fraction: double, random_baseline: double>"
    rows = [("a", "m", "g", (0.5, 0.2, 0.1)), ("b", "m", "g", (0.75, None, 0.1)), ("c", "m", "g", None)]
    sinks.write_results(spark.createDataFrame(rows, fields), str(tmp_path / "loc"))
    read = sources.read_results(spark, str(tmp_path / "loc"), {"method": "string", "macro": fields.split("macro ")[1]})
    assert [(r.experiment, r.pointing_game, r.energy_fraction) for r in runs.localization_table(read).collect()] == [("b", 0.75, None), ("a", 0.5, 0.2)]
    metrics = spark.createDataFrame([("a", "m", 0.5, 1.0), ("b", "m", 0.25, None)], "experiment string, model string, auroc double, extra double")
    sinks.write_results(metrics, str(tmp_path / "met"))
    table = runs.compare_runs(sources.read_results(spark, str(tmp_path / "met"), {"auroc": "double", "extra": "double"}), ["a", "b"], ["auroc", "extra"])
    assert {r.metric: (r.a, r.b) for r in table.collect()} == {"auroc": (0.5, 0.25), "extra": (1.0, None)}
    report = [(e, "m", 0, a, v, g, 0.1, 0.2, True, False, False) for e in "ab" for a, v, g in (("sex", "M", 0.0), ("sex", "F", 0.3), ("age", "0-19", None))]
    types = "run_id int, axis string, level string, auroc_gap double, fnr_gap double, underdiagnosis_gap double, auroc_resolved boolean, fnr_resolved boolean, underdiagnosis_resolved boolean"
    sinks.write_report(spark.createDataFrame(report, f"experiment string, model string, {types}"), str(tmp_path / "bias"))
    back = sources.report_rows(spark, str(tmp_path / "bias"), types).withColumn("run_id", F.ascii("experiment"))
    overall = spark.createDataFrame([(97, 0.6), (98, 0.7)], "run_id int, auroc double")
    got = reports.bias_comparison(overall, back, {"sex": ["M", "F"], "age": ["0-19"]}).collect()
    assert [(r.run_id, r.sex_F_auroc_gap, r.sex_F_auroc_resolved, r.age_0_19_auroc_gap) for r in got] == [(98, 0.3, True, None), (97, 0.3, True, None)]


def test_thresholds_tables_and_splits(spark, pred, tmp_path):
    t = pred.select("run_id", "class_idx", F.lit(0.5).alias("threshold")).distinct()
    sinks.write_thresholds(t, str(tmp_path / "t"), {"objective": "f1"})
    assert json.loads(spark.read.parquet(str(tmp_path / "t")).first().settings) == {"objective": "f1"}
    sinks.write_table(t, str(tmp_path / "c"))
    sinks.write_splits(pred.select("study_id", "split").distinct(), str(tmp_path / "s"))
    assert len(list((tmp_path / "c").glob("*.csv"))) == 1
    assert {p.name for p in (tmp_path / "s").glob("split=*")} == {"split=val", "split=test"}


def test_members_side_by_side_without_a_shuffle(spark, pred):
    """On a bucketed table the cells of checks, means, log-odds and co-moments are found where they lie; the results are those of any other table."""
    table = sinks.save_members(pred.where("split = 'val'"), "members_of_test", bucket_rows=3)
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        cells = table.groupBy("split", "study_id", "class_idx").agg(F.count("*").alias("rows"))
        for df in (cells, ensemble.combine(table, "mean"), ensemble.combine(table, "logit")):
            assert "Exchange" not in plan(df) and "Bucketed: true" in plan(df)
        assert plan(ensemble.co_moments(table)).count("Exchange") == 1  # of tasks' matrices
        assert plan(ensemble.combine(pred.where("split = 'val'"), "mean")).count("Exchange") > 0
        sources.check_members(table)
        want = ensemble.combine(pred.where("split = 'val'"), "logit")
        assert sorted(map(tuple, ensemble.combine(table, "logit").collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.sql("DROP TABLE members_of_test")


def test_counts_of_patients_repeat_no_rows(spark):
    rows = [(1, "p", "M", 30), (2, "p", "M", 31), (3, "q", "F", 85), (4, "q", "F", 30), (5, "r", None, None)]
    studies = spark.createDataFrame(rows, "study_id int, patient_id string, sex string, age int")
    got = labels.subgroup_counts(studies)
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.axis, r.sex, r.band): (r.n, r.patients) for r in got.collect()} == {
        (1, "M", None): (2, 1), (1, "F", None): (2, 1), (1, None, None): (1, 1), (2, None, "20-39"): (3, 2), (2, None, "80-100"): (1, 1), (2, None, None): (1, 1), (3, None, None): (5, 3)}
