"""Rates by subgroup and their gaps to a reference level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeval.labels import age_band
from sparkeval.ranking import rank_sums, swept
from sparkeval.staging import stage
from sparkeval.thresholds import safe_ratio

REFERENCE = {"sex": "M", "age": "40-59"}


def sex_level(column: str = "sex") -> Column:
    """M or F; null for anything else."""
    return F.when(F.col(column).isin("M", "F"), F.col(column))


AXES = ("sex", "age")


def levels() -> dict[str, Column]:
    """A study's level on each axis, or null."""
    return {"sex": sex_level(), "age": age_band()}


def by_axis() -> Column:
    """axis and level of each axis that a row, whose levels stand in columns named for the axes, has a level on."""
    return F.inline(F.filter(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("level")) for a in AXES]), lambda x: x["level"].isNotNull()))


def by_level(fired: DataFrame) -> DataFrame:
    """Each row once for each axis it has a level on."""
    each = F.filter(F.array(F.struct(F.lit("sex").alias("axis"), sex_level().alias("level")), F.struct(F.lit("age").alias("axis"), age_band().alias("level"))), lambda x: x["level"].isNotNull())
    return fired.withColumn("__l", F.explode(each)).withColumns({"axis": F.col("__l.axis"), "level": F.col("__l.level")}).drop("__l")


def shared_levels(fired: DataFrame, least: int = 10) -> DataFrame:
    """run_id, axis, level and class_idx with enough positives both in the level and in its reference, and their rows; rows are counted before they are laid out by axis."""
    sums = {"pos": F.sum("label"), "rows": F.count("*")}
    first = fired.groupBy("run_id", "class_idx", *[v.alias(k) for k, v in levels().items()]).agg(*[v.alias(k) for k, v in sums.items()])
    n = first.select("run_id", "class_idx", *sums, by_axis()).groupBy("run_id", "axis", "level", "class_idx").agg(*[F.sum(k).alias(k) for k in sums])
    n = n.where(F.col("pos") >= least).drop("pos")
    reference = F.when(F.col("axis") == "sex", REFERENCE["sex"]).otherwise(REFERENCE["age"])
    return n.join(n.where(F.col("level") == reference).drop("level", "rows"), ["run_id", "axis", "class_idx"], "left_semi")


def shared_classes(fired: DataFrame, least: int = 10) -> DataFrame:
    """run_id, axis, level and class_idx with enough positives both in the level and in its reference."""
    return shared_levels(fired, least).drop("rows")


def by_study(fired: DataFrame) -> DataFrame:
    """Studies' sums over their classes: run_id, study_id, patient_id, sex, age, positives, label and fired (1 if any is). Texts are keys here, as Spark sorts all rows for their least."""
    sums = {"positives": F.sum("label"), "label": F.max("label"), "fired": F.max("fired")}
    return fired.groupBy("run_id", "study_id", "patient_id", "sex", "age").agg(*[v.alias(k) for k, v in sums.items()])


def abnormal_studies(fired: DataFrame, studies: DataFrame | None = None) -> DataFrame:
    """A row for each run and study with a finding; `fired` is 1 if any class is called. studies: by_study(fired), where it is at hand."""
    each = (by_study(fired) if studies is None else studies).groupBy("run_id", "study_id")
    each = each.agg(F.min("patient_id").alias("patient_id"), F.min("sex").alias("sex"), F.min("age").alias("age"), F.max("label").alias("label"), F.max("fired").alias("fired"))
    return each.where("label = 1")


def underdiagnosis(fired: DataFrame, studies: DataFrame | None = None) -> DataFrame:
    """Share of studies with a finding for which no class is called, for each level of each axis. studies: by_study(fired), where it is at hand."""
    rows = by_level(abnormal_studies(fired, studies))
    return rows.groupBy("run_id", "axis", "level").agg(F.count("*").alias("abnormal"), F.avg((F.col("fired") == 0).cast("double")).alias("underdiagnosis"))


def level_counts(fired: DataFrame) -> DataFrame:
    """Positives, rows and called positives at each score of each run, axis, level and class; rows are counted before they are laid out by axis."""
    sums = {"pos": F.sum("label").cast("long"), "n": F.count("*"), "hits": F.sum(F.col("fired") * F.col("label")).cast("long")}
    first = fired.groupBy("run_id", "class_idx", "score", sex_level().alias("sex"), age_band().alias("band")).agg(*[v.alias(k) for k, v in sums.items()])
    levels = F.filter(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(c).alias("level")) for a, c in (("sex", "sex"), ("age", "band"))]), lambda x: x["level"].isNotNull())
    rows = first.select("run_id", "class_idx", "score", *sums, F.inline(levels))
    return rows.groupBy("run_id", "axis", "level", "class_idx", "score").agg(*[F.sum(k).alias(k) for k in sums])


def bias_table(gaps: DataFrame, levels: dict[str, list[str]], columns: tuple[str, ...] = ("auroc_gap", "fnr_gap")) -> DataFrame:
    """A row for each run and a column axis_level_gap for each level but the reference; null where a run has none."""
    cells = [F.max(F.when((F.col("axis") == a) & (F.col("level") == v), F.col(c))).alias(f"{a}_{v}_{c}".replace("-", "_")) for a, vs in levels.items() for v in vs if v != REFERENCE[a] for c in columns]
    return gaps.groupBy("run_id").agg(*cells)


def subgroup_gaps(fired: DataFrame, least: int = 10) -> DataFrame:
    """Macro AUROC and miss rate of each level and of the reference over the classes with enough positives in both, and the gap."""
    keys = ("run_id", "axis", "level", "class_idx")
    s = swept(level_counts(fired), keys, "hits").groupBy(*keys).agg(*rank_sums(), F.sum("hits").alias("hits"))
    c = stage(s.select(*keys, "support", "auroc", (1 - safe_ratio(F.col("hits"), F.col("support"))).alias("fnr")), "level_rates")
    reference = F.when(F.col("axis") == "sex", REFERENCE["sex"]).otherwise(REFERENCE["age"])
    ref = c.where(F.col("level") == reference).select("run_id", "axis", "class_idx", F.col("support").alias("rs"), F.col("auroc").alias("ra"), F.col("fnr").alias("rf"))
    both = c.join(ref, ["run_id", "axis", "class_idx"]).where((F.col("support") >= least) & (F.col("rs") >= least))
    g = both.groupBy("run_id", "axis", "level").agg(F.count("*").alias("classes"), F.avg("auroc").alias("auroc"), F.avg("ra").alias("ref_auroc"), F.avg("fnr").alias("fnr"), F.avg("rf").alias("ref_fnr"))
    return g.withColumns({"auroc_gap": F.col("auroc") - F.col("ref_auroc"), "fnr_gap": F.col("fnr") - F.col("ref_fnr")})
