"""Delimited labels, profiles and patient tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_FINDING = "No Finding"
# fixed values: age bands, both ends inside
BANDS = ((0, 19), (20, 39), (40, 59), (60, 79), (80, 100))


def split_labels(column: str) -> Column:
    return F.transform(F.split(F.col(column), r"\|"), lambda x: F.trim(x))


def multi_hot(studies: DataFrame, classes: list[str], column: str = "finding_labels") -> DataFrame:
    """studies with `labels`: 0 or 1 for each class; names that are not classes are ignored."""
    return studies.withColumn("labels", F.array(*[F.array_contains(split_labels(column), c).cast("int") for c in classes]))


def label_counts(studies: DataFrame, column: str = "finding_labels") -> DataFrame:
    return shares(studies.select(F.explode(split_labels(column)).alias("finding")), "finding")


def label_numbers(studies: DataFrame, column: str = "finding_labels") -> DataFrame:
    """How many studies have how many findings, with shares; no finding counts as none."""
    found = F.size(F.filter(split_labels(column), lambda x: (x != NO_FINDING) & (x != "")))
    return shares(studies.select(found.alias("findings")), "findings")


def shares(rows: DataFrame, column: str) -> DataFrame:
    """Rows of each value of a column with few values, and their share."""
    c = rows.groupBy(column).count()
    return c.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(1))))


def profile(rows: DataFrame) -> DataFrame:
    """A row for each column: rows, nulls, and for numbers mean, deviation (of the sample), least and greatest; all in one pass."""
    numeric = {c for c, t in rows.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")}
    none = F.lit(None).cast("double")
    cells = []
    for c in rows.columns:
        v = F.col(f"`{c}`").cast("double") if c in numeric else none
        measures = {"n": F.count("*"), "nulls": F.count_if(F.col(f"`{c}`").isNull()), "mean": F.avg(v), "std": F.stddev(v), "least": F.min(v), "greatest": F.max(v)}
        cells.append(F.struct(F.lit(c).alias("column"), *[m.alias(k) for k, m in measures.items()]))
    return rows.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def sample_rows(rows: DataFrame, n: int, key: str, seed: int = 17) -> DataFrame:
    """Exactly n rows (all, if fewer) in the order of a hash of their key: the same for the same seed, a prefix of a larger sample."""
    return rows.orderBy(portable_hash(key, seed), key).limit(n)


def list_overlap(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Distinct keys of two lists and those in both."""
    a, b = first.select(key).distinct().withColumn("a", F.lit(1)), second.select(key).distinct().withColumn("b", F.lit(1))
    return a.join(b, key, "full").agg(F.count("a").alias("first"), F.count("b").alias("second"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"))


def cooccurrence(studies: DataFrame, classes: list[str], column: str = "finding_labels") -> DataFrame:
    """Studies with both of two classes and their share among those with the first (of 1 where it has none), the most frequent classes first.

    Every pair of classes has a row; a study gives at most classes squared pairs.
    """
    s = studies.select(F.array_intersect(split_labels(column), F.array(*[F.lit(c) for c in classes])).alias("f"))
    counts = s.select("f", F.explode("f").alias("a")).select("a", F.explode("f").alias("b")).groupBy("a", "b").count()
    every = studies.sparkSession.createDataFrame([(a, b) for a in classes for b in classes], "a string, b string")
    c = every.join(counts, ["a", "b"], "left").na.fill(0, ["count"])
    own = c.where("a = b").select("a", F.col("count").alias("support"))
    c = c.join(own, "a").join(own.withColumnsRenamed({"a": "b", "support": "other"}), "b")
    out = c.select("a", "b", "count", (F.col("count") / F.greatest("support", F.lit(1))).alias("share"), "support", "other")
    return out.orderBy(F.desc("support"), "a", F.desc("other"), "b").drop("support", "other")


def age_band(age: str = "age") -> Column:
    """Band with both ends inside; null where the age is none or above the last band."""
    out = F.when(F.lit(False), "")
    for lo, hi in BANDS:
        out = out.when(F.col(age).cast("double").between(lo, hi), f"{lo}-{hi}")
    return out


def counted(per: DataFrame, keys: Sequence[str], *sums: str, n: str | None = None) -> DataFrame:
    """keys, n, patients and sums: rows (or, with `n`, the sum of that column) and different patients, which are reduced to a row each first and then counted.

    No row is repeated for the sake of several distinct counts.
    """
    rows = F.sum(n) if n else F.count("*")
    patients = per.groupBy(*keys, "patient_id").agg(rows.alias("n"), *[F.sum(c).alias(c) for c in sums])
    return patients.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("patient_id").alias("patients"), *[F.sum(c).alias(c) for c in sums])


def subgroup_counts(studies: DataFrame) -> DataFrame:
    """sex, band, axis, n and patients by sex (axis 1), by band (2) and in all (3)."""
    none = F.lit(None).cast("string")
    first = studies.groupBy("patient_id", "sex", age_band().alias("band")).agg(F.count("*").alias("studies"))  # about a row for each patient
    sides = [(1, F.col("sex"), none), (2, none, F.col("band")), (3, none, none)]
    sides = F.array(*[F.struct(F.lit(i).cast("long").alias("axis"), s.alias("of_sex"), b.alias("of_band")) for i, s, b in sides])
    return counted(first.select("patient_id", "studies", F.inline(sides)).withColumnsRenamed({"of_sex": "sex", "of_band": "band"}), ("sex", "band", "axis"), n="studies")


def patient_table(studies: DataFrame, classes: list[str]) -> DataFrame:
    hot = multi_hot(studies, classes)
    return hot.groupBy("patient_id").agg(F.count("*").alias("images"), *[F.sum(F.col("labels")[i]).alias(c.lower()) for i, c in enumerate(classes)])


def split_violations(studies: DataFrame, key: str = "study_id") -> DataFrame:
    """Keys that are in more than one split, with the number of their splits."""
    return studies.groupBy(key).agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def leakage(studies: DataFrame) -> DataFrame:
    """Patients that occur in more than one split, by pair of splits."""
    p = studies.select("patient_id", "split").distinct()
    q = p.select(F.col("patient_id"), F.col("split").alias("other"))
    pairs = p.select("split").distinct().crossJoin(q.select("other").distinct()).where("split < other")
    found = p.join(q, "patient_id").where("split < other").groupBy("split", "other").agg(F.count("*").alias("n"))
    return pairs.join(found, ["split", "other"], "left").select("split", "other", F.coalesce("n", F.lit(0)).cast("long").alias("shared"))


def portable_hash(key: str, seed: int) -> Column:
    """32 bits of a key of any type, the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")


def grouped_folds(rows: DataFrame, folds: int, seed: int = 17, key: str = "patient_id", id_col: str = "study_id") -> DataFrame:
    """Patients dealt over folds in the order of a portable hash; buckets of the hash are ranked apart and joined by running counts.

    Rows without a patient column are dealt one by one.
    """
    key = key if key in rows.columns else id_col
    p = rows.select(key).distinct().withColumn("h", portable_hash(key, seed)).withColumn("bucket", F.shiftright("h", 20))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = p.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("h", key)) - 1 + F.col("first")
    return p.join(F.broadcast(first), "bucket").select(key, (rank % folds).cast("int").alias("fold"))  # 4096 buckets


def age_histogram(studies: DataFrame, bins: int = 30, most: int | None = None) -> DataFrame:
    """Studies in each of `bins` equal parts of the ages' range, of those up to `most` only if given; one age is in the middle part."""
    s = studies.where(F.col("age").isNotNull()) if most is None else studies.where(F.col("age") <= most)
    ends = s.agg(F.min("age").alias("lo"), F.max("age").alias("hi"))
    b = F.least(F.floor(F.try_divide((F.col("age") - F.col("lo")) * F.lit(bins), F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    return s.crossJoin(F.broadcast(ends)).groupBy(F.when(F.col("hi") > F.col("lo"), b).otherwise(bins // 2).cast("int").alias("bin")).agg(F.count("*").alias("n"))  # one row


def implausible_ages(studies: DataFrame, most: int = 100) -> DataFrame:
    """Rows and patients over the age limit, the highest age and the distinct ones in order."""
    return studies.where(F.col("age") > most).agg(
        F.count("*").alias("n"), F.count_distinct("patient_id").alias("patients"), F.max("age").alias("highest"), F.array_join(F.array_sort(F.collect_set("age")), ",").alias("ages"))
