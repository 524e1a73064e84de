"""Prediction, study and finding tables derived from the TPC-H-like tables; one SQL text for Spark and for the oracle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkeval.staging import stage

CTES = """
hit AS (
  SELECT DISTINCT l.l_orderkey AS study_id, p.p_type AS finding
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  WHERE l.l_quantity > CASE p.p_type WHEN 'STANDARD' THEN 10 WHEN 'SMALL' THEN 20 WHEN 'LARGE' THEN 30
                                     WHEN 'ECONOMY' THEN 40 WHEN 'MEDIUM' THEN 45 ELSE 49 END),
study AS (
  SELECT o_orderkey AS study_id, o_custkey AS patient_id,
         CASE WHEN o_custkey % 8 < 4 THEN 'M' ELSE 'F' END AS sex,
         CAST(floor((c_acctbal + 1000.0) / 100.0) AS INT) AS age,
         CASE o_custkey % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split
  FROM orders JOIN customer ON o_custkey = c_custkey),
cls AS (SELECT * FROM (VALUES (0,'ECONOMY'),(1,'LARGE'),(2,'MEDIUM'),(3,'PROMO'),(4,'SMALL'),(5,'STANDARD')) AS t(class_idx, class_name)),
run AS (SELECT run_id, experiment, model, CAST(s AS DOUBLE) AS strength FROM (VALUES
   (0,'exp_a','net_x',0.35),(1,'exp_b','net_x',0.30),(2,'exp_c','net_y',0.28),(3,'exp_d','net_z',0.25),(4,'exp_e','net_w',0.02)) AS t(run_id, experiment, model, s)),
pred AS (
  SELECT r.run_id, r.experiment, r.model, s.split, s.study_id, s.patient_id, s.sex, s.age, k.class_idx, k.class_name,
         CASE WHEN h.finding IS NULL THEN 0 ELSE 1 END AS label,
         (CASE WHEN h.finding IS NULL THEN 0 ELSE 1 END) * r.strength
         + (CAST(1 AS DOUBLE) - r.strength)
           * (CAST(((s.study_id % 1009) + 1) * ((s.study_id % 2003) + 17 * r.run_id + 31 * k.class_idx + 1) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE)) AS score
  FROM study s CROSS JOIN cls k CROSS JOIN run r
  LEFT JOIN hit h ON h.study_id = s.study_id AND h.finding = k.class_name)"""
# the rows of `pred` and `cell`, its cells without runs, where a study's findings meet it as bits before classes and runs are laid out: a row a study is shuffled, not 30
SEEN = """
found AS (
  SELECT l.l_orderkey AS study_id, bit_or(shiftleft(1, k.class_idx)) AS bits
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN cls k ON p.p_type = k.class_name
  WHERE l.l_quantity > CASE p.p_type WHEN 'STANDARD' THEN 10 WHEN 'SMALL' THEN 20 WHEN 'LARGE' THEN 30
                                     WHEN 'ECONOMY' THEN 40 WHEN 'MEDIUM' THEN 45 ELSE 49 END
  GROUP BY l.l_orderkey),
seen AS (SELECT s.*, coalesce(f.bits, 0) AS bits FROM study s LEFT JOIN found f ON f.study_id = s.study_id)"""
CELLS = """
cell AS (SELECT s.*, k.class_idx, k.class_name, shiftright(s.bits, k.class_idx) & 1 AS label FROM seen s CROSS JOIN cls k),
scored AS (
  SELECT r.run_id, r.experiment, r.model, c.split, c.study_id, c.patient_id, c.sex, c.age, c.class_idx, c.class_name, c.label,
         c.label * r.strength
         + (CAST(1 AS DOUBLE) - r.strength)
           * (CAST(((c.study_id % 1009) + 1) * ((c.study_id % 2003) + 17 * r.run_id + 31 * c.class_idx + 1) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE)) AS score
  FROM cell c CROSS JOIN run r)"""
HISTORY = """SELECT user_id AS run_id, day(ts) AS epoch, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) AS value, count(*) AS seconds
  FROM {events} GROUP BY user_id, day(ts)"""
BATCHES = """SELECT user_id AS run_id, event_id AS batch_idx, 1 + event_id % 32 AS images, CAST(round(value * 100) AS BIGINT) AS seconds FROM {events}"""
TABLES = ("lineitem", "part", "orders", "customer")
STUDIES_A_FILE = 25_000


def bridge(spark: SparkSession, sf_dir: str, select: str) -> DataFrame:
    """`select` over the bridge's tables."""
    text = f"{CTES},{SEEN},{CELLS}"
    for t in TABLES:
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    return spark.sql(f"WITH {text} {select}", **{t: frames[t] for t in TABLES})


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge(spark, sf_dir, "SELECT * FROM scored")


def staged_studies(spark: SparkSession, sf_dir: str, which: str = "true") -> tuple[DataFrame, int]:
    """The studies that `which` picks with their findings as bits, a staged row each, and the number of parts they are dealt over. A patient's studies lie together."""
    seen = bridge(spark, sf_dir, f"SELECT * FROM seen WHERE {which}")
    parts = spark.read.parquet(f"{sf_dir}/orders.parquet").count() // STUDIES_A_FILE + 1
    return stage(seen.repartition(parts, "patient_id").sortWithinPartitions("patient_id", "study_id"), "studies"), parts


def laid_out(seen: DataFrame) -> DataFrame:
    """The predictions of staged studies, with the patient's `slot` if they have it. Rows dealt over tasks by study stay so."""
    fixed, cells = CTES[CTES.index("cls AS") : CTES.index(",\npred AS")], CELLS.replace("FROM seen ", "FROM {seen} ")
    if "slot" in seen.columns:
        cells = cells.replace("c.label,\n", "c.label, c.slot,\n")
    return seen.sparkSession.sql(f"WITH {fixed},{cells} SELECT * FROM scored", seen=seen)


def staged_predictions(spark: SparkSession, sf_dir: str, which: str = "true") -> DataFrame:
    """The predictions of the studies that `which` picks, from a staged table of a row a study; each reader lays out classes and runs anew, so that they are never written.

    A patient's studies lie together, so that sums by study or patient are added up before they are shuffled.
    """
    return laid_out(staged_studies(spark, sf_dir, which)[0])


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge(spark, sf_dir, "SELECT * FROM study")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies with their findings joined by | in name order, or No Finding."""
    labels = bridge(spark, sf_dir, "SELECT study_id, array_join(sort_array(collect_list(finding)), '|') AS finding_labels FROM hit GROUP BY study_id")
    return studies(spark, sf_dir).join(labels, "study_id", "left").na.fill("No Finding", ["finding_labels"])


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user as run and a day as epoch: mean value of its events as metric, their number as seconds."""
    return spark.sql(HISTORY, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BATCHES, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of 8 x 8 cells from vectors (negative values are 0) with one box each."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cells = F.transform("embedding", lambda v: F.greatest(v.cast("double"), F.lit(0.0)))
    box = F.struct(*[c.cast("double").alias(k) for k, c in {"x": F.col("vec_id") % 5, "y": F.col("vec_id") % 4, "w": F.col("vec_id") % 3 + 1, "h": F.col("vec_id") % 2 + 2}.items()])
    return e.select(F.col("vec_id").alias("image_id"), F.col("label").alias("class_idx"), cells.alias("cells"), F.array(box).alias("boxes"))


def stages(spark: SparkSession, sf_dir: str, n: int = 3) -> DataFrame:
    """The maps n + 1 times; stage s is turned by s cells."""
    s, size = F.col("stage"), F.size("cells")
    m = maps(spark, sf_dir).withColumn("stage", F.explode(F.sequence(F.lit(0), F.lit(n))))
    return m.withColumn("cells", F.concat(F.slice("cells", s + 1, size - s), F.slice("cells", F.lit(1), s)))


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of 8 x 8 cells with one rectangle of equal cells each, and the boxes of `maps`; `px`, `py`, `pw`, `ph` say where it is."""
    v = F.col("vec_id")
    place = {"px": v % 6, "py": v % 7, "pw": 1 + v % 2, "ph": 1 + v % 3}
    m = maps(spark, sf_dir).withColumnRenamed("image_id", "vec_id").withColumns({k: c.cast("int") for k, c in place.items()})

    def cell(i):
        x, y = i % 8, F.floor(i / 8)
        inside = (x >= F.col("px")) & (x < F.col("px") + F.col("pw")) & (y >= F.col("py")) & (y < F.col("py") + F.col("ph"))
        return F.when(inside, 1.0 + v % 5).otherwise(0.25)

    return m.withColumn("cells", F.transform(F.sequence(F.lit(0), F.lit(63)), cell)).withColumnRenamed("vec_id", "image_id")


def cell_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split, study_id, class_idx and label of every cell once; they are the same in all runs."""
    cells = "SELECT split, study_id, class_idx, shiftright(bits, class_idx) & 1 AS label FROM (SELECT DISTINCT split, study_id, bits FROM seen) CROSS JOIN cls"
    return bridge(spark, sf_dir, cells)


def epoch_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation predictions with a made-up epoch: a quarter of the patients each."""
    return predictions(spark, sf_dir).where("split = 'val'").withColumn("epoch", (F.col("patient_id") % 4).cast("int"))


def incomplete_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of runs of which the last one, by a made-up fault, lacks its test rows."""
    return predictions(spark, sf_dir).where("NOT (run_id = 4 AND split = 'test')")


def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """experiment, split and n: the summaries that runs left behind; by a made-up fault only the first three did."""
    p = predictions(spark, sf_dir).where("class_idx = 0").groupBy("run_id", "experiment", "split").agg(F.count("*").alias("n"))
    return p.where("run_id < 3").drop("run_id")


def overlapping_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two made-up lists of studies, every third and every fifth."""
    p = studies(spark, sf_dir)
    return p.where("study_id % 3 = 0"), p.where("study_id % 5 = 0")


def leaking_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """study_id and split, where by a made-up fault a seventh of the training studies is in validation too."""
    p = studies(spark, sf_dir).select("study_id", "split")
    return p.unionByName(p.where("split = 'train' AND study_id % 7 = 0").withColumn("split", F.lit("val")))


def flawed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation predictions with made-up faults: run 1 lacks some studies, run 2 has other labels, run 3 other patients, run 4 some rows twice."""
    p = predictions(spark, sf_dir).where("split = 'val'").select("run_id", "split", "study_id", "patient_id", "class_idx", "label", "score")
    i = F.col("study_id")
    p = p.where(~((F.col("run_id") == 1) & (i % 11 == 0)))
    p = p.withColumn("label", F.when((F.col("run_id") == 2) & (i % 13 == 0), 1 - F.col("label")).otherwise(F.col("label")))
    p = p.withColumn("patient_id", F.when((F.col("run_id") == 3) & (i % 17 == 0), -F.col("patient_id")).otherwise(F.col("patient_id")))
    return p.unionByName(p.where((F.col("run_id") == 4) & (i % 19 == 0)))


def box_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as an annotation file has them: another name for one class, a class that is none, and a column that nobody reads."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = F.col("vec_id")
    finding = F.when(F.col("label") == 0, " Infiltrate").when(F.col("label") == 1, "Elsewhere").otherwise(F.concat(F.lit("class_"), F.col("label")))
    return e.select(F.concat(v, F.lit(".png")).alias("Image Index"), finding.alias("Finding Label"), (v % 5).alias("x"), (v % 4).alias("y"), (v % 3 + 1).alias("w"), (v % 2 + 2).alias("h"), F.lit("-").alias("Unnamed: 6"))


def linear_model(classes: int = 10, width: int = 64):
    """A fixed linear model: class k weighs feature i by ((k + 1) (i + 3) mod 7 - 3) / 4."""

    def load():
        k, i = np.arange(classes)[:, None], np.arange(width)[None, :]
        weights = ((k + 1) * (i + 3) % 7 - 3) / 4.0
        return lambda rows: rows @ weights.T

    return load


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), "label", F.col("embedding").alias("features"))
