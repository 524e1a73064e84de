"""Heatmaps against boxes and against each other. Scores are array expressions, blobs and rank correlations small Arrow helpers.

Maps are shuffled only to bring the stages of one instance together.

A map is `cells`, an array in row order with `width` cells in a row. Boxes are structs x, y, w, h on the map's grid.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# fixed values: overlaps that are counted as reached
LEVELS = (0.1, 0.25, 0.5, 0.75, 0.9)


def normalize(cells: str = "cells") -> Column:
    lo, hi = F.array_min(cells), F.array_max(cells)
    return F.transform(cells, lambda v: (v - lo) / (hi - lo + 1e-8))


def blank(cells: str = "cells") -> Column:
    return F.array_max(cells) <= 0


def box_mask(boxes: str | Column, width: int, height: int) -> Column:
    """1 for each cell that a box touches, else 0; boxes are cut at the border and empty ones ignored."""

    def inside(i: Column, b: Column) -> Column:
        x, y = i % width, F.floor(i / width)
        across = (x >= F.floor(b["x"])) & (x < F.ceil(b["x"] + b["w"]))
        return across & (y >= F.floor(b["y"])) & (y < F.ceil(b["y"] + b["h"])) & (b["w"] > 0) & (b["h"] > 0)

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: F.exists(boxes, lambda b: inside(i, b)).cast("int"))


def score_maps(maps: DataFrame, width: int, height: int) -> DataFrame:
    """maps with degenerate, hit (the first highest cell lies in a box; never on a blank map), energy (share of the raw map inside) and area."""
    m = maps.withColumn("mask", box_mask("boxes", width, height))
    zero, add = F.lit(0.0), lambda a, v: a + v
    inside = F.aggregate(F.zip_with("cells", "mask", lambda v, k: v * k), zero, add)
    total = F.aggregate("cells", zero, add)
    peak = F.element_at("mask", F.array_position("cells", F.array_max("cells")).cast("int"))
    scored = {
        "degenerate": blank(),
        "hit": ~blank() & (peak == 1),
        "energy": F.when(total > 0, F.try_divide(inside, total)).otherwise(0.0),
        "area": F.aggregate("mask", F.lit(0), add) / (width * height),
    }
    return m.withColumns(scored).drop("mask")


def localization_summary(scored: DataFrame, key: str = "class_idx") -> DataFrame:
    """Pointing accuracy, energy, the random baseline and the share of blank maps of each class."""
    return scored.groupBy(key).agg(
        F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("pointing"), F.avg("energy").alias("energy"),
        F.avg("area").alias("baseline"), F.avg(F.col("degenerate").cast("double")).alias("degenerate"),
    )


def largest_blobs(grids: np.ndarray) -> np.ndarray:
    """Masks of the largest 4-connected region of each of n x height x width masks; of equal ones the first in row order."""
    n, h, w = grids.shape
    none = h * w
    label = np.where(grids.reshape(n, -1), np.arange(none), none)
    while True:
        g = np.pad(label.reshape(n, h, w), ((0, 0), (1, 1), (1, 1)), constant_values=none)
        near = np.minimum.reduce([g[:, 1:-1, 1:-1], g[:, :-2, 1:-1], g[:, 2:, 1:-1], g[:, 1:-1, :-2], g[:, 1:-1, 2:]]).reshape(n, -1)
        near = np.where(label == none, none, near)
        jumped = np.take_along_axis(np.pad(near, ((0, 0), (0, 1)), constant_values=none), near, axis=1)
        if np.array_equal(jumped, label):
            break
        label = jumped
    sizes = np.zeros((n, none + 1), dtype=np.int64)
    np.add.at(sizes, (np.arange(n)[:, None], label), 1)
    sizes[:, none] = 0
    return ((label == sizes.argmax(axis=1)[:, None]) & (label < none)).reshape(n, h, w)


def predicted_box(width: int, height: int, share: float = 0.5, cells: str = "cells") -> Column:
    """Struct x, y, w, h around the largest blob of the cells with at least `share` of the map's maximum; null for a blank map."""

    @F.pandas_udf("x double, y double, w double, h double")
    def boxes(values: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(np.nan, index=values.index, columns=["x", "y", "w", "h"])
        if len(values):
            v = np.stack(values.to_numpy()).reshape(-1, height, width)
            top = v.max(axis=(1, 2))
            blob = largest_blobs((v >= share * top[:, None, None]) & (top > 0)[:, None, None])
            for name, size, axis, length in (("x", "w", 1, width), ("y", "h", 2, height)):
                any_cell = blob.any(axis=axis)
                first, last = any_cell.argmax(axis=1), length - any_cell[:, ::-1].argmax(axis=1)
                out[name], out[size] = np.where(top > 0, first, np.nan), np.where(top > 0, last - first, np.nan)
        return out

    box = boxes(F.col(cells))
    return F.when(~blank(cells), box)


def score_boxes(maps: DataFrame, width: int, height: int, share: float = 0.5) -> DataFrame:
    """maps with `predicted`, `detected`, and IoU and intersection over the predicted box against the union of the true boxes (0 without one)."""
    m = maps.withColumn("predicted", predicted_box(width, height, share))
    m = m.withColumns({"truth": box_mask("boxes", width, height), "found": box_mask(F.array_compact(F.array("predicted")), width, height)})
    zero, add = F.lit(0.0), lambda a, v: a + v
    both, own, truth = F.aggregate(F.zip_with("found", "truth", lambda a, b: a * b), zero, add), F.aggregate("found", zero, add), F.aggregate("truth", zero, add)
    m = m.withColumns({"detected": F.col("predicted").isNotNull(), "both": both, "own": own, "all": own + truth - both})
    ratio = {"iou": F.coalesce(F.try_divide("both", "all"), zero), "iobb": F.coalesce(F.try_divide("both", "own"), zero)}
    return m.withColumns(ratio).drop("truth", "found", "both", "own", "all")


def overlap_summary(scored: DataFrame, keys: tuple[str, ...] = ("class_idx",), levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """Mean IoU and IoBB, the detected share, and the share that reaches each level, for each key."""
    reached = [F.avg((F.col(k) >= t).cast("double")).alias(f"{k}_at_{round(100 * t)}") for k in ("iou", "iobb") for t in levels]
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("iou").alias("iou"), F.avg("iobb").alias("iobb"), F.avg(F.col("detected").cast("double")).alias("detected"), *reached)


def score_localization(maps: DataFrame, scores: DataFrame, width: int, height: int, threshold: float = 0.5, share: float = 0.5) -> DataFrame:
    """maps (image_id, class_idx, method, cells, boxes) with the measures of score_maps and score_boxes, and what the classifier said.

    scores: image_id, class_idx, label, score and, where classes have their own, `threshold`. Added are `probability` and `fired` of the map's
    class, and absent_class, absent_score and absent_fired of the highest-scoring class that the image has not; no absent class is not fired.
    """
    limit = F.col("threshold") if "threshold" in scores.columns else F.lit(threshold)
    own = scores.select("image_id", "class_idx", F.col("score").alias("probability"), (F.col("score") >= limit).alias("fired"))
    top = F.max(F.when(F.col("label") == 0, F.struct(F.col("score"), -F.col("class_idx"), (F.col("score") >= limit)))).alias("t")
    absent = scores.groupBy("image_id").agg(top).select("image_id", (-F.col("t.col2")).alias("absent_class"), F.coalesce("t.score", F.lit(0.0)).alias("absent_score"), F.coalesce("t.col3", F.lit(False)).alias("absent_fired"))
    scored = score_boxes(score_maps(maps, width, height), width, height, share)
    return scored.join(own, ["image_id", "class_idx"]).join(absent, "image_id")


def localization_report(scored: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """Measures of each method and class (class_idx null: their mean over the classes), over all maps and over those whose class was called.

    scored: score_localization with `method`. Columns: method, where (`all`, `fired`), class_idx, instances and the measures.
    """
    both = scored.withColumn("where", F.explode(F.when(F.col("fired"), F.array(F.lit("all"), F.lit("fired"))).otherwise(F.array(F.lit("all")))))
    names = {"pointing": "hit", "energy": "energy", "baseline": "area", "iou": "iou", "iobb": "iobb", "detected": "detected", "degenerate": "degenerate"}
    measures = [F.avg(F.col(c).cast("double")).alias(k) for k, c in names.items()]
    measures += [F.avg((F.col(k) >= t).cast("double")).alias(f"{k}_at_{round(100 * t)}") for k in ("iou", "iobb") for t in levels]
    each = both.groupBy("method", "where", "class_idx").agg(F.count("*").alias("instances"), *measures)
    means = [F.avg(c).alias(c) for c in each.columns if c not in ("method", "where", "class_idx", "instances")]
    over = each.groupBy("method", "where").agg(F.sum("instances").alias("instances"), *means).withColumn("class_idx", F.lit(None).cast("int"))
    return each.unionByName(over)


def diagnostic_cases(scored: DataFrame, n: int, id_col: str = "image_id") -> DataFrame:
    """Up to n cases of each of six kinds, with their place from 1; equal ones in the order of id and class.

    scored: id, class_idx, energy, hit, fired (the class was called), absent_score and absent_fired (the top absent class). A row gives the kinds it belongs to
    in one scan, and each task keeps the n first of a kind before they meet.
    """
    energy, absent = F.col("energy"), F.col("absent_score")
    kinds = {
        "localized": (F.col("fired") & F.col("hit"), -energy), "mislocalized": (F.col("fired") & ~F.col("hit"), energy), "missed": (~F.col("fired"), -energy),
        "false_positive": (F.col("absent_fired"), -absent), "best": (F.lit(True), -energy), "worst": (F.lit(True), energy),
    }
    entries = F.array(*[F.when(rule, F.struct(F.lit(kind).alias("kind"), order.alias("order"))) for kind, (rule, order) in kinds.items()])
    each = scored.select(id_col, "class_idx", "energy", "absent_score", F.inline(F.array_compact(entries)).alias("kind", "order"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("order", id_col, "class_idx"))
    return each.withColumn("place", place).where(F.col("place") <= n).select("kind", "place", id_col, "class_idx", "energy", "absent_score")


@F.pandas_udf(DoubleType())
def _spearman(first: pd.Series, second: pd.Series) -> pd.Series:
    def ranks(v: np.ndarray) -> np.ndarray:
        """Mean ranks within each row: the mean of the first and the last place of equal values in the sorted row."""
        order = np.argsort(v, axis=1, kind="stable")
        s, place = np.take_along_axis(v, order, axis=1), np.arange(v.shape[1])
        new = np.hstack([np.ones((len(v), 1), bool), s[:, 1:] != s[:, :-1]])
        first_at = np.maximum.accumulate(np.where(new, place, 0), axis=1)
        ends = np.hstack([new[:, 1:], np.ones((len(v), 1), bool)])
        last_at = np.minimum.accumulate(np.where(ends, place, v.shape[1])[:, ::-1], axis=1)[:, ::-1]
        out = np.empty(v.shape)
        np.put_along_axis(out, order, (first_at + last_at) / 2 + 1, axis=1)
        return out

    out = np.full(len(first), np.nan)
    sizes = np.array([len(a) if len(a) == len(b) else 0 for a, b in zip(first, second)])
    for size in np.unique(sizes[sizes > 0]):  # maps of one size together
        at = np.flatnonzero(sizes == size)
        x, y = (ranks(np.stack(m.iloc[at].to_numpy())) for m in (first, second))
        x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
        spread = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
        out[at] = np.divide((x * y).sum(axis=1), spread, out=np.full(len(at), np.nan), where=spread > 0)
    return pd.Series(out, index=first.index)


def rank_correlation(first: str, second: str) -> Column:
    """Spearman's correlation of two maps; null if one is blank or constant."""
    rho = _spearman(F.col(first), F.col(second))
    return F.when(~blank(first) & ~blank(second), F.when(~F.isnan(rho), rho))


def drift_table(stages: DataFrame, width: int, height: int, id_col: str = "image_id") -> DataFrame:
    """For each stage: mean rank correlation with stage 0 and the number of comparable maps, pointing accuracy, baseline, share of blank maps.

    stages: id, stage, cells, boxes.
    """
    first = stages.where("stage = 0").select(id_col, F.col("cells").alias("original"))
    scored = score_maps(stages.join(first, id_col), width, height).withColumn("rho", rank_correlation("original", "cells"))
    return scored.groupBy("stage").agg(
        F.count("*").alias("n"), F.avg("rho").alias("correlation"), F.count("rho").alias("comparable"), F.avg(F.col("hit").cast("double")).alias("pointing"),
        F.avg("area").alias("baseline"), F.avg(F.col("degenerate").cast("double")).alias("degenerate"),
    )


def drift_verdict(drift: DataFrame, alarm: float = 0.5) -> DataFrame:
    """The first stage after 0 whose correlation is at most `alarm` in size, the last stage's correlation, and whether that is above it."""
    low = (F.col("stage") > 0) & (F.abs("correlation") <= alarm)
    v = drift.agg(F.min(F.when(low, F.col("stage"))).alias("decorrelated_at"), F.max("stage").alias("stages"), F.max_by("correlation", "stage").alias("final"))
    return v.withColumn("alarm", F.coalesce(F.col("final") > alarm, F.lit(False)))
