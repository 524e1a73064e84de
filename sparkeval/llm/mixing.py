"""Mixing sources to target weights with hash-threshold histograms.

Words are summed by source and hash bucket; running sums find the bucket in which a source's budget ends, only that bucket is
divided again, and after the last level a document is taken if its hash lies below its source's threshold. Nothing is sorted:
each level is one aggregation with map-side combining, so a hot source costs no more than its share of the scan. What is
left in front of a large document at the boundary goes to smaller ones the same way. Budgets of more than one whole copy are nested: every document gets the whole copies, and the threshold grants one more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkeval.llm.common import read, small, stage

WORDS = r"[^\x20\x09-\x0D]+"
BITS, LEVELS = 12, 4  # 48 hash bits, 12 of them at each level
ROUNDS = 3  # what the first threshold leaves of a budget goes to smaller documents above it, twice
SEED = "mix"


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """sizes (source, source_size) with weight and target. One row per source passes through one task.

    Sources in code-point order (null last) take the weights in turn and share the sum of all sizes. A target above
    `most` times its source's size is held there and the excess is shared again by weight, until none is above: with sources
    in order of most * size / weight, the first ones are held, and the rest share what they leave at one common rate.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(w) for w in weights])
    w = sizes.withColumn("weight", F.get(turn, (F.row_number().over(order) - 1) % len(weights)).cast("double"))
    w = w.withColumn("held", F.lit(float(most)) * F.col("source_size"))
    by = Window.orderBy(F.col("held") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("held").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumn("rate", (F.sum("source_size").over(every) - before) / left)
    w = w.withColumn("fits", F.col("rate") * F.col("weight") <= F.col("held"))
    rate = F.min(F.when(F.col("fits"), F.struct(F.col("held") / F.col("weight"), F.col("rate").alias("rate")))).over(every)
    w = w.withColumn("common", rate["rate"])
    target = F.least(F.col("held"), F.coalesce(F.col("common") * F.col("weight"), F.col("held")))
    return w.select("source", "source_size", "weight", target.alias("target"))


def _threshold(narrow: DataFrame, sources: DataFrame, turn: int, n_sources: int) -> DataFrame:
    """sources (s, gap, below of earlier turns) with this turn's hash threshold, and the budget that it leaves.

    Looks at documents above the last threshold that are no larger than the budget left.
    """
    last = f"below{turn}"
    state = sources.select("s", F.col(last).alias("from"), F.col(f"gap{turn}").alias("gap"), F.lit(0).cast("long").alias("spent"), F.lit(0).cast("long").alias("prefix"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = (F.shiftright("h", shift + BITS) == F.col("prefix")) & (F.col("h") >= F.col("from")) & (F.col("size") <= F.col("gap"))
        hist = (
            narrow.where("size > 0")
            .join(small(state, n_sources), F.col("source").eqNullSafe(F.col("s")) & inside)
            .groupBy("s", F.shiftright("h", shift).alias("bucket"))
            .agg(F.sum("size").alias("words"), F.first("gap").alias("gap"), F.first("spent").alias("spent"), F.first("from").alias("from"))
        )
        upto = F.col("spent") + F.sum("words").over(Window.partitionBy("s").orderBy("bucket"))
        # the boundary: the first bucket whose running sum passes the budget
        edge = hist.withColumn("upto", upto).where("upto > gap").groupBy("s")
        state = edge.agg(F.min(F.struct("bucket", "upto", "words", "gap", "from")).alias("b")).select(
            "s", "b.from", "b.gap", (F.col("b.upto") - F.col("b.words")).alias("spent"), F.col("b.bucket").alias("prefix")
        )
    edge = state.select(F.col("s").alias("__s"), (F.col("gap") - F.col("spent")).alias("left"), F.col("prefix").alias("edge"))
    out = sources.join(small(edge, n_sources), F.col("s").eqNullSafe(F.col("__s")), "left")
    return out.select(
        *sources.columns,
        F.coalesce("edge", F.lit(1 << BITS * LEVELS)).alias(f"below{turn + 1}"),  # none: all of them fit
        F.coalesce("left", F.lit(0.0)).alias(f"gap{turn + 1}"),
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    most: float = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows: bool = False,
) -> DataFrame:
    """id, source, size (words), source_size, target and copies of every document; with `rows` also its input row as struct `row`.

    A document's hash comes from its id (of a null id, from its text), so reruns agree. Null texts have no words. Repeated
    rows share a hash and are taken together. A source without words has target 0. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.concat_ws(":", F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.md5(text)))
    base = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(key), 1, BITS), 16, 10).cast("long").alias("h"),
        *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * rows,
    )
    # the narrow table is scanned once a level; whole rows are not written twice
    narrow = stage(base.drop("row"), "mix_sizes")
    sources = stage(
        source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix_sources"
    )
    n_sources = sources.count()
    whole = F.floor(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))
    sources = sources.withColumn("whole", whole).withColumnRenamed("source", "s")
    sources = sources.withColumn("gap0", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("below0", F.lit(0).cast("long"))
    for turn in range(ROUNDS):
        sources = stage(_threshold(narrow, sources, turn, n_sources), "mix_limits")
    more = F.lit(False)
    for turn in range(ROUNDS):
        more |= (F.col("h") >= F.col(f"below{turn}")) & (F.col("size") <= F.col(f"gap{turn}")) & (F.col("h") < F.col(f"below{turn + 1}"))
    out = (base if rows else narrow).join(small(sources, n_sources), F.col("source").eqNullSafe(F.col("s")))
    copies = F.col("whole") + F.when(more, 1).otherwise(0)
    return out.select("id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), *["row"] * rows)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with docs' columns: each document as often as it is taken."""
    out = mix_sources(docs, rows=True, **options).where("copies > 0")
    return out.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix_sources(read(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source"
    )


OP4_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 12) AS BIGINT) AS h
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
             3.0::DOUBLE * source_size AS held FROM sizes),
r AS (SELECT *, (CAST((SELECT sum(size) FROM base) AS DOUBLE)
                 - coalesce(sum(held) OVER (ORDER BY held / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY held / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w),
c AS (SELECT arg_min(rate, held / weight) AS common FROM r WHERE rate * weight <= held),
t AS (SELECT source, source_size, least(held, coalesce(common * weight, held)) AS target FROM r CROSS JOIN c),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM t),
d AS (SELECT b.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS gap
      FROM base b JOIN p ON b.source IS NOT DISTINCT FROM p.source),
d1 AS (SELECT *, CASE WHEN size <= gap AND size > 0 THEN sum(CASE WHEN size <= gap THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) END AS upto FROM d),
e1 AS (SELECT *, coalesce(min(CASE WHEN upto > gap THEN h END) OVER (PARTITION BY source), 281474976710656) AS edge FROM d1),
f1 AS (SELECT *, upto IS NOT NULL AND h < edge AS taken1, gap - coalesce(sum(CASE WHEN upto IS NOT NULL AND h < edge THEN size END) OVER (PARTITION BY source), 0) AS gap1 FROM e1),
d2 AS (SELECT * EXCLUDE (upto, edge), edge AS edge1, CASE WHEN h >= edge AND size <= gap1 AND size > 0 THEN sum(CASE WHEN h >= edge AND size <= gap1 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) END AS upto FROM f1),
e2 AS (SELECT *, coalesce(min(CASE WHEN upto > gap1 THEN h END) OVER (PARTITION BY source), 281474976710656) AS edge FROM d2),
f2 AS (SELECT *, upto IS NOT NULL AND h < edge AS taken2, gap1 - coalesce(sum(CASE WHEN upto IS NOT NULL AND h < edge THEN size END) OVER (PARTITION BY source), 0) AS gap2 FROM e2),
d3 AS (SELECT * EXCLUDE (upto, edge), edge AS edge2, CASE WHEN h >= edge AND size <= gap2 AND size > 0 THEN sum(CASE WHEN h >= edge AND size <= gap2 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) END AS upto FROM f2),
e3 AS (SELECT *, coalesce(min(CASE WHEN upto > gap2 THEN h END) OVER (PARTITION BY source), 281474976710656) AS edge FROM d3)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN taken1 OR taken2 OR (upto IS NOT NULL AND h < edge) THEN 1 ELSE 0 END) AS BIGINT) AS taken, source FROM e3
"""
