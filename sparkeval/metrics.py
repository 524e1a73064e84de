"""Image-level, calibration and loss metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeval.ranking import KEYS, rank_metrics, score_counts, swept
from sparkeval.staging import same_keys, small, stage
from sparkeval.thresholds import safe_ratio


def image_sums() -> list[Column]:
    """What image-level metrics need of a study's cells."""
    same = F.sum((F.col("fired") == F.col("label")).cast("int"))
    return [F.sum(F.col("fired") * F.col("label")).alias("tp"), F.sum("fired").alias("called"), F.sum("label").alias("true"), same.alias("same"), F.count("*").alias("n")]


def image_means() -> list[Column]:
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("called") + F.col("true")), F.lit(1.0))
    none = (F.col("true") == 0).cast("double")
    return [
        F.avg(f1).alias("samples_f1"), F.avg(none).alias("samples_f1_none"), F.avg((F.col("same") == F.col("n")).cast("double")).alias("subset_accuracy"),
        F.avg(none).alias("subset_accuracy_none"), F.avg(F.col("same") / F.col("n")).alias("sample_accuracy"),
        F.avg(1 - F.col("same") / F.col("n")).alias("hamming_loss"), F.avg(F.col("true") / F.col("n")).alias("hamming_loss_none"),
    ]


def per_image(fired: DataFrame, runs: Sequence[str] = ("run_id",)) -> DataFrame:
    """Samples-F1 (1 where nothing is called and nothing is there), subset and sample accuracy, Hamming loss, and their all-negative baselines."""
    return fired.groupBy(*runs, "study_id").agg(*image_sums()).groupBy(*runs).agg(*image_means())


def micro(fired: DataFrame, runs: Sequence[str] = ("run_id",)) -> DataFrame:
    """Precision, recall, F1 and average precision over all cells of a run."""
    c = fired.groupBy(*runs).agg(F.sum(F.col("fired") * F.col("label")).alias("tp"), F.sum("fired").alias("called"), F.sum("label").alias("true"))
    c = c.select(*runs, safe_ratio(F.col("tp"), F.col("called")).alias("precision"), safe_ratio(F.col("tp"), F.col("true")).alias("recall"), safe_ratio(2 * F.col("tp"), F.col("called") + F.col("true")).alias("f1"))
    return c.join(rank_metrics(fired, runs).select(*runs, "auprc"), list(runs))


def brier(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return pred.groupBy(*keys).agg(F.avg((F.col("score") - F.col("label")) ** 2).alias("brier"))


def score_quantiles(sweep: DataFrame, steps: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """keys and `edges`: exact quantiles of counted scores, interpolated between neighbours, equal ones once.

    sweep: what ranking.swept gives. Its running counts tell which scores stand at the ranks that are asked for; only these are kept.
    """
    c = sweep.withColumn("above", F.col("tp") + F.col("fp") - F.col("n"))  # rows of higher scores
    low, high = F.col("total") - F.col("above") - F.col("n"), F.col("total") - F.col("above")  # ranks from the bottom that the score has
    at = [F.lit(q) * (F.col("total") - 1) for q in steps]
    ends = [F.max(F.when((r.cast("long") >= low) & (r.cast("long") < high), F.col("score"))).alias(f"{side}{i}") for i, x in enumerate(at) for side, r in (("lo", F.floor(x)), ("hi", F.ceil(x)))]
    e = c.groupBy(*keys).agg(F.max("total").alias("total"), *ends)
    between = [(F.ceil(x) - x) * F.col(f"lo{i}") + (x - F.floor(x)) * F.col(f"hi{i}") for i, x in enumerate(at)]
    edges = [F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.col(f"lo{i}")).otherwise(b) for i, b in enumerate(between)]
    return e.select(*keys, F.array_sort(F.array_distinct(F.array_compact(F.array(*edges)))).alias("edges"))


def _check_binning(strategy: str) -> None:
    if strategy not in ("quantile", "uniform"):
        raise ValueError(f"unknown binning strategy {strategy}")


def calibration_error(sweep: DataFrame, bins: int, strategy: str, keys: Sequence[str]) -> DataFrame:
    """ECE per key from the steps of a sweep. Bins are (lower, upper], the first one takes its own edge; equal quantile edges are merged."""
    _check_binning(strategy)
    steps = [i / bins for i in range(bins + 1)]
    if strategy == "uniform":
        edged = sweep.withColumn("edges", F.array(*[F.lit(s) for s in steps]))
    else:
        edges = stage(score_quantiles(sweep, steps, keys), "ece_edges")
        edged = same_keys(sweep, small(edges, edges.count(), 64 + 8 * bins), keys)
    last = F.greatest(F.size("edges") - 2, F.lit(0))
    below = F.size(F.filter("edges", lambda e: e < F.col("score"))) - 1
    b = edged.withColumn("bin", F.least(F.greatest(below, F.lit(0)), last)).groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("score")).alias("s"), F.sum("pos").alias("l"))
    return b.groupBy(*keys).agg((F.sum(F.abs(F.col("s") - F.col("l"))) / F.sum("n")).alias("ece"))


def expected_calibration_error(pred: DataFrame, bins: int = 15, strategy: str = "quantile", keys: Sequence[str] = KEYS) -> DataFrame:
    """ECE per key; uniform bins need no order of the scores."""
    _check_binning(strategy)
    counts = score_counts(pred, keys)
    return calibration_error(counts if strategy == "uniform" else stage(swept(counts, keys), "ece_sweep"), bins, strategy, keys)


#: Up to so many classes a study's scores are multiplied in a column a class, beyond in a sorted list.
PRODUCT_CLASSES = 64


def screening_scores(classes: Sequence | None = None) -> list[Column]:
    """A study's highest score and its noisy-or, in the order of the classes. Where all classes that occur are named, no scores are collected and sorted."""
    if classes is not None and len(classes) <= PRODUCT_CLASSES:
        of = [F.product(F.when(F.col("class_idx").eqNullSafe(F.lit(k)), 1 - F.col("score"))) for k in sorted(classes, key=lambda k: (k is not None, k))]
        none = reduce(lambda a, p: a * F.coalesce(p, F.lit(1.0)), of, F.lit(1.0))
        return [F.max("score").alias("max"), F.when(F.count("score") == F.count("*"), 1 - none).alias("noisy_or")]
    scores = F.array_sort(F.collect_list(F.struct("class_idx", "score")))
    return [F.max("score").alias("max"), (1 - F.aggregate(scores, F.lit(1.0), lambda a, x: a * (1 - x["score"]))).alias("noisy_or")]


def normal_vs_abnormal(pred: DataFrame, runs: Sequence[str] = ("run_id",)) -> DataFrame:
    """AUROC and average precision of the highest score and of noisy-or for a study with any finding."""
    i = pred.groupBy(*runs, "study_id").agg(F.max("label").alias("label"), *screening_scores())
    i = i.select(*runs, "label", F.explode(F.create_map(F.lit("max"), F.col("max"), F.lit("noisy_or"), F.col("noisy_or"))).alias("rule", "score"))
    return rank_metrics(i, (*runs, "rule")).withColumn("prevalence", F.col("support") / F.col("n"))


def losses(pred: DataFrame, keys: Sequence[str] = KEYS, gamma_neg: float = 4, gamma_pos: float = 1, clip: float = 0.05, eps: float = 1e-6) -> DataFrame:
    """Mean binary cross-entropy and asymmetric loss; scores are probabilities."""
    p = F.least(F.greatest(F.col("score"), F.lit(eps)), F.lit(1 - eps))
    q = F.least(1 - p + clip, F.lit(1.0))
    bce = F.when(F.col("label") == 1, -F.ln(p)).otherwise(-F.ln(1 - p))
    asl = F.when(F.col("label") == 1, -F.ln(p) * (1 - p) ** gamma_pos).otherwise(-F.ln(F.greatest(q, F.lit(eps))) * (1 - q) ** gamma_neg)
    return pred.groupBy(*keys).agg(F.avg(bce).alias("bce"), F.avg(asl).alias("asl"))


def bce_from_logits(rows: DataFrame, keys: Sequence[str] = KEYS, logit: str = "logit", weight: str | None = None) -> DataFrame:
    """Mean binary cross-entropy of logits, in the form that does not overflow; positives weigh `weight` where that column is named."""
    x, y = F.col(logit), F.col("label")
    soft = F.log1p(F.exp(-F.abs(x)))  # of the size of the logit
    up, down = F.greatest(-x, F.lit(0.0)) + soft, F.greatest(x, F.lit(0.0)) + soft
    w = F.col(weight) if weight else F.lit(1.0)
    return rows.groupBy(*keys).agg(F.avg(w * y * up + (1 - y) * down).alias("bce"))


def class_support(pred: DataFrame, keys: Sequence[str] = ("split", "class_idx")) -> DataFrame:
    """Positives, rows and prevalence."""
    return pred.groupBy(*keys).agg(F.sum("label").alias("support"), F.count("*").alias("n"), F.avg(F.col("label").cast("double")).alias("prevalence"))


def positive_weights(pred: DataFrame, keys: Sequence[str] = ("class_idx",), most: float = 25.0) -> DataFrame:
    pos, n = F.sum("label"), F.count("*")
    return pred.groupBy(*keys).agg(F.least(F.greatest((n - pos + 1.0) / (pos + 1.0), F.lit(1.0)), F.lit(most)).alias("pos_weight"))


def top_absent(fired: DataFrame, runs: Sequence[str] = ("run_id",)) -> DataFrame:
    """For each study the class without a finding that scores highest, its score and whether it was called; of equal ones the first class."""
    absent = fired.where("label = 0").groupBy(*runs, "study_id")
    return absent.agg(F.max(F.struct("score", -F.col("class_idx"), "fired")).alias("t")).select(*runs, "study_id", (-F.col("t.col2")).alias("class_idx"), "t.score", "t.fired")


def explanation_target(fired: DataFrame, runs: Sequence[str] = ("run_id",)) -> DataFrame:
    """The class to explain for each study: the highest-scoring called one, else (note `none called`) the highest of all."""
    best = F.max(F.struct(F.col("fired"), F.col("score"), -F.col("class_idx")))
    t = fired.groupBy(*runs, "study_id").agg(best.alias("t"))
    return t.select(*runs, "study_id", (-F.col("t.col3")).alias("class_idx"), "t.score", F.when(F.col("t.fired") == 0, "none called").alias("note"))


def failures(fired: DataFrame, runs: Sequence[str] = ("run_id",)) -> DataFrame:
    """Studies with a class called wrongly at a score above 0.5, with the numbers of false and of missed calls."""
    over = (F.col("score") > 0.5).cast("int")
    f = fired.groupBy(*runs, "study_id").agg(F.sum(over * (1 - F.col("label"))).alias("false_calls"), F.sum((1 - over) * F.col("label")).alias("missed"))
    return f.where("false_calls + missed > 0")
