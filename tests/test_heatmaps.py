import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkeval import heatmaps, runs


def one(spark, boxes, cells, width, height):
    text = ", ".join(f"struct({x}d AS x, {y}d AS y, {w}d AS w, {h}d AS h)" for x, y, w, h in boxes)
    values = ", ".join(f"{v}d" for v in cells)
    return spark.sql(f"SELECT 1 AS image_id, 0 AS class_idx, array({values}) AS cells, array({text}) AS boxes, {width} AS w, {height} AS h")


@pytest.mark.parametrize(
    ("boxes", "cells"),
    [([(1, 2, 3, 4)], 12), ([(0, 0, 2, 2), (1, 1, 2, 2)], 7), ([(6, 6, 9, 9)], 4), ([(1, 1, 0, 5)], 0), ([(0.5, 0.5, 1, 1)], 4)],
)
def test_box_mask(spark, boxes, cells):
    m = one(spark, boxes, [0], 8, 8).select(heatmaps.box_mask("boxes", 8, 8).alias("m")).first().m
    assert len(m) == 64 and sum(m) == cells


def test_blank_map_is_a_miss_even_in_the_corner(spark):
    r = heatmaps.score_maps(one(spark, [(0, 0, 1, 1)], [0] * 4, 2, 2), 2, 2).first()
    assert (r.degenerate, r.hit, r.energy, r.area) == (True, False, 0.0, 0.25)


def test_energy_and_peak(spark):
    r = heatmaps.score_maps(one(spark, [(1, 0, 1, 1)], [1, 2, 1, 0], 2, 2), 2, 2).first()
    assert (r.degenerate, r.hit, r.energy) == (False, True, 0.5)


def test_early_stop_ignores_nulls_and_stops_when_patience_ends(spark):
    values = [0.1, None, 0.3, 0.3, 0.2, 0.9]
    h = spark.createDataFrame([(1, e, v, 1) for e, v in enumerate(values)], "run_id int, epoch int, value double, seconds int")
    got = runs.early_stop(h, patience=2).orderBy("epoch").collect()
    assert [(r.epoch, r.improved, r.waited) for r in got] == [(0, True, 0), (1, False, 1), (2, True, 0), (3, False, 1), (4, False, 2)]
    assert runs.training_summary(runs.early_stop(h, patience=2)).first().best_epoch == 2


def test_runs_of_different_classes_are_not_compared(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "experiment string, class_name string")
    with pytest.raises(ValueError, match="different classes"):
        runs.check_comparable(rows)
    runs.check_comparable(rows.where(F.col("experiment") == "a"))


def flood(mask):
    """The largest region of a mask, by search from each cell."""
    seen, best = set(), []
    for start in zip(*np.where(mask)):
        if start in seen:
            continue
        region, todo = [], [start]
        seen.add(start)
        while todo:
            y, x = todo.pop()
            region.append((y, x))
            for c in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if 0 <= c[0] < mask.shape[0] and 0 <= c[1] < mask.shape[1] and mask[c] and c not in seen:
                    seen.add(c)
                    todo.append(c)
        best = max(best, region, key=len)
    out = np.zeros_like(mask)
    for c in best:
        out[c] = True
    return out


def test_largest_blobs():
    grids = np.random.default_rng(5).random((60, 9, 7)) < 0.55
    grids[0] = False
    assert all(np.array_equal(a, flood(b)) for a, b in zip(heatmaps.largest_blobs(grids), grids))


@pytest.mark.parametrize(
    ("truth", "peak", "iou", "iobb"),
    [((0, 0, 20, 20), (0, 0, 10, 10), 0.25, 1.0), ((0, 0, 5, 5), (10, 10, 5, 5), 0.0, 0.0), ((0, 0, 20, 20), (15, 0, 10, 10), 50 / 450, 0.5), ((0, 0, 5, 5), None, 0.0, 0.0)],
)
def test_overlap(spark, truth, peak, iou, iobb):
    g = np.zeros((32, 32))
    if peak:
        x, y, w, h = peak
        g[y : y + h, x : x + w] = 1.0
        g[31, 31] = 0.9  # a smaller blob
    r = heatmaps.score_boxes(one(spark, [truth], g.ravel(), 32, 32), 32, 32).first()
    assert r.detected == (peak is not None) and (r.iou, r.iobb) == pytest.approx((iou, iobb))
    assert peak is None or (r.predicted.x, r.predicted.y, r.predicted.w, r.predicted.h) == peak


def test_rank_correlation(spark):
    rows = [([1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), ([1.0, 2.0, 3.0], [3.0, 2.0, 1.0]), ([1.0, 2.0, 3.0], [0.0, 0.0, 0.0]), ([1.0, 1.0, 1.0], [1.0, 2.0, 3.0])]
    got = spark.createDataFrame(rows, "a array<double>, b array<double>").select(heatmaps.rank_correlation("a", "b").alias("r")).collect()
    assert [None if r.r is None else round(r.r, 9) for r in got] == [1.0, -1.0, None, None]


def test_diagnostic_cases(spark):
    rows = [(1, 0, 0.9, True, True, 0.2, False), (2, 0, 0.1, False, True, 0.8, True), (3, 0, 0.5, False, False, 0.9, True), (4, 0, 0.5, True, True, 0.1, False)]
    s = spark.createDataFrame(rows, "image_id int, class_idx int, energy double, hit boolean, fired boolean, absent_score double, absent_fired boolean")
    got = {}
    for r in heatmaps.diagnostic_cases(s, 2).collect():
        got.setdefault(r.kind, []).append(r.image_id)
    plan = heatmaps.diagnostic_cases(s, 2)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2 and plan.count("Union") == 0  # one scan; each task keeps the first ones before the shuffle
    assert got == {"localized": [1, 4], "mislocalized": [2], "missed": [3], "false_positive": [3, 2], "best": [1, 3], "worst": [2, 3]}


def test_normalized_maps(spark):
    """Between 0 and 1 by each map's own range; a constant map is 0 everywhere, not undefined."""
    m = spark.createDataFrame([(1, [2.0, 4.0, 3.0]), (2, [5.0, 5.0, 5.0]), (3, [-1.0, 0.0, 1.0])], "image_id int, cells array<double>")
    got = {r.image_id: r.n for r in m.select("image_id", heatmaps.normalize().alias("n")).collect()}
    assert got[1] == pytest.approx([0, 1, 0.5], abs=1e-7) and got[2] == [0, 0, 0] and got[3] == pytest.approx([0, 0.5, 1], abs=1e-7)
