"""Connected components by contraction: every node points to its smallest neighbour, pointers are doubled to their roots, edges
between roots stay for the next round. Stars need one round; each round at least halves the nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeval.llm.common import drop_staged, small, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, component), the component being its smallest node; nodes without edges don't appear."""
    left = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    out = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "components")
        while True:
            ahead = to.select(F.col("node").alias("component"), F.col("component").alias("root"))
            n = to.count()
            jumped = stage(to.join(small(ahead, n), "component").select("node", F.col("root").alias("component"), (F.col("root") != F.col("component")).alias("moved")), "components")
            drop_staged(to)
            done = jumped.where("moved").isEmpty()
            to = jumped.drop("moved")
            if done:
                break
        ends = to.select(F.col("node").alias("a"), F.col("component").alias("a2")), to.select(F.col("node").alias("b"), F.col("component").alias("b2"))
        rest = left.join(small(ends[0], n), "a").join(small(ends[1], n), "b").where("a2 <> b2")
        rest = stage(rest.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        drop_staged(left)
        left = rest
        if out is None:
            out = to
        else:
            later = to.select(F.col("node").alias("component"), F.col("component").alias("root"))
            out = stage(out.join(small(later, n), "component", "left").select("node", F.coalesce("root", "component").alias("component")), "components")
    return out if out is not None else left.select(F.col("a").alias("node"), F.col("b").alias("component"))
