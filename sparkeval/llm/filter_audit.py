"""How filters interact, for every order in which they could run, from decision diagrams.

Each document becomes a mask of the filters that it fails; masks are counted per part (map-side first), so a part of any size is
at most 2 ** k counts. They become a decision diagram with a level for each filter: nodes are shared where what lies below
them is equal, and weigh the documents below. Swapping two adjacent levels rewires only the nodes of these two, and a sequence of such swaps
visits all orders; the path from the root on which every filter passes gives an order's steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeval.llm.common import read, stage

WORDS = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#$%&*|]"
COPY = "E"

Weight = tuple[int, int, int]  # documents, good ones, toxic ones


def text_filters(least_words: int = 50, distinct: int = 65, capitals: int = 5, symbols: str = SYMBOLS) -> dict[str, Callable[[Column, Column], Column]]:
    """Failure conditions on a text and its array of words: too few words, too few different ones (per cent), too many capitals (per cent), a symbol."""
    return {
        "A": lambda text, words: F.size(words) < least_words,
        "B": lambda text, words: F.size(F.array_distinct(words)) * 100 < F.size(words) * distinct,
        "C": lambda text, words: F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text) * capitals,
        "D": lambda text, words: text.rlike(symbols),
    }


def failure_masks(
    docs: DataFrame,
    filters: dict[str, Callable[[Column, Column], Column]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """id, part and mask of every row: bit i is set where filter i fails, the last bit where a smaller id has the same text.

    Null texts and parts are empty. Texts are compared by their SHA-256. A null id is neither a copy nor has one; repeated rows of an id are no
    copies of each other. An empty table gives an empty result; other columns are not looked at.
    """
    filters = text_filters() if filters is None else filters
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    base = base.withColumn("words", F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))
    own = sum((fails(F.col("text"), F.col("words")).cast("int") * (1 << i) for i, fails in enumerate(filters.values())), F.lit(0))
    rows = stage(base.select("id", "part", own.alias("mask"), F.unhex(F.sha2("text", 256)).alias("key")), "filter_masks")
    # the smallest id of a text meets its own row by both: no text's copies meet in one task
    first = rows.groupBy("key").agg(F.min("id").alias("id")).where("id is not null").withColumn("first", F.lit(True))
    rows = rows.join(first, ["key", "id"], "left")
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return rows.select("id", "part", (F.col("mask") + copy.cast("int") * (1 << len(filters))).alias("mask"))


def with_labels(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """masks with good and toxic (0 or 1). Of repeated labels of an id a 1 counts; a document without any has neither."""
    each = labels.groupBy(F.col(f"`{id_col}`").cast("long").alias("id"))
    each = each.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("good = 1 or toxic = 1")
    none = F.lit(0)
    return masks.join(each, "id", "left").withColumns({"good": F.coalesce("good", none), "toxic": F.coalesce("toxic", none)})


class Diagram:
    """A decision diagram over k filters: levels[i] holds the nodes that test filter order[i], as pairs of nodes of the level below for pass and
    fail; the nodes of the last level point to leaves. A node is shared by all masks below which counts are the same."""

    def __init__(self, counts: dict[int, Weight], k: int):
        self.order = list(range(k))
        leaves: dict[Weight, int] = {}
        below = [leaves.setdefault(counts.get(mask, (0, 0, 0)), len(leaves)) for mask in range(1 << k)]
        self.levels: list[list[tuple[int, int]]] = []
        self.weights = [list(leaves)]  # of the nodes of each level, and of the leaves at last
        for i in range(k - 1, -1, -1):
            nodes: dict[tuple[int, int], int] = {}
            below = [nodes.setdefault((below[m], below[m | 1 << i]), len(nodes)) for m in range(1 << i)]
            self.levels.insert(0, list(nodes))
            self.weights.insert(0, [self._sum(self.weights[0], n) for n in nodes])

    @staticmethod
    def _sum(weights: list[Weight], node: tuple[int, int]) -> Weight:
        a, b = weights[node[0]], weights[node[1]]
        return a[0] + b[0], a[1] + b[1], a[2] + b[2]

    def swap(self, i: int) -> None:
        """Exchange levels i and i + 1. A node of level i stays the same function of the masks, so that nothing above or below changes."""
        upper, lower = self.levels[i], self.levels[i + 1]
        nodes: dict[tuple[int, int], int] = {}
        for j, (passed, failed) in enumerate(upper):
            (a, b), (c, d) = lower[passed], lower[failed]
            upper[j] = nodes.setdefault((a, c), len(nodes)), nodes.setdefault((b, d), len(nodes))
        self.levels[i + 1] = list(nodes)
        self.weights[i + 1] = [self._sum(self.weights[i + 2], n) for n in nodes]
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]

    def path(self) -> Iterator[tuple[int, Weight, Weight]]:
        """The filters in their order, with the weights of what passes this one and all before, and of what only this one stops."""
        at = 0
        for i, f in enumerate(self.order):
            passed, failed = self.levels[i][at]
            yield f, self.weights[i + 1][passed], self.weights[i + 1][failed]
            at = passed


def plain_changes(k: int) -> list[int]:
    """Places of adjacent swaps that visit all orders of k: the last element sweeps through each order of the others."""
    if k < 2:
        return []
    out, inner = [], plain_changes(k - 1)
    for turn in range(len(inner) + 1):
        out += range(k - 1) if turn % 2 else range(k - 2, -1, -1)
        if turn < len(inner):
            out.append(inner[turn] + (0 if turn % 2 else 1))
    return out


def audit(counts: dict[int, Weight], names: str) -> Iterator[tuple]:
    """filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley for each order and step."""
    k = len(names)
    diagram, orders = Diagram(counts, k), []
    alone, unique, total = [0] * k, [0] * k, [0] * k
    for place in [None, *plain_changes(k)]:
        if place is not None:
            diagram.swap(place)
        steps = list(diagram.path())
        orders.append(steps)
        alone[steps[0][0]], unique[steps[-1][0]] = steps[0][2][0], steps[-1][2][0]
        for f, _, gone in steps:
            total[f] += gone[0]
    for steps in orders:
        order = "".join(names[f] for f, _, _ in steps)
        for i, (f, kept, gone) in enumerate(steps, 1):
            yield order, i, kept[0], gone[0], alone[f] - gone[0], unique[f], gone[1], gone[2], total[f]


STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def interactions(masks: DataFrame, names: str) -> DataFrame:
    """A row for each part, order and step. masks: part, mask, good and toxic; names: a letter for each bit of the mask."""
    counts = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))
    each = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most a count for each mask

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, masks in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist(), strict=True):
                rows = list(audit({m["mask"]: (m["n"], m["good"], m["toxic"]) for m in masks}, names))
                columns = [pa.array([part] * len(rows), pa.string())]
                for i, values in enumerate(zip(*rows, strict=True)):
                    columns.append(pa.array(values, pa.string() if i == 0 else pa.int32() if i == 1 else pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in STEPS.split(", ")])

    return each.mapInArrow(run, STEPS)


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    masks = failure_masks(read(spark, sf_dir, "documents"))
    return interactions(with_labels(masks, read(spark, sf_dir, "labels")), "ABCD" + COPY)


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT doc_id, part,
        CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
        + CASE WHEN len(list_distinct(words)) * 100 < len(words) * 65 THEN 2 ELSE 0 END
        + CASE WHEN len(regexp_extract_all(t, '[A-Z]')) * 100 > length(t) * 5 THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN first < doc_id THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(f, bit)),
p AS (SELECT a.f || b.f || x.f || y.f || z.f AS filter_order, [a.bit, b.bit, x.bit, y.bit, z.bit] AS bits
      FROM f a JOIN f b ON a.f <> b.f JOIN f x ON x.f NOT IN (a.f, b.f) JOIN f y ON y.f NOT IN (a.f, b.f, x.f) JOIN f z ON z.f NOT IN (a.f, b.f, x.f, y.f)),
s AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM p CROSS JOIN (SELECT range AS step FROM range(1, 6))),
r AS (SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & before = 0 AND mask & bit = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c CROSS JOIN s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
