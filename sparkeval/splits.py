"""Stratified splits and nested subsets by patient.

A patient's fold is a function of its labels and of a hash of its id. The driver only sees sums per range of the hash, which it divides further only where
the border of a fold lies, down to a single patient; so the number of patients is of no matter to it, and no window or join runs over them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeval.labels import sample_rows
from sparkeval.staging import numbered, stage

BUCKETS = 65536


def bucket(key: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(BUCKETS)).cast("int")


BITS, LEVELS = 63, (47, 31, 15, 0)  # of a patient's place; ranges of places by their first 16 bits, 32, 48, all


def place(key: str, seed: int) -> Column:
    """A patient's place in the order in which folds are cut: 63 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), 1)


@dataclass
class Stratification:
    """Labels in the order they were placed and, for each and for patients without any, the first place of each fold but the first."""

    order: list[str]
    bounds: list[list[int]]
    seed: int

    def fold(self, key: str = "patient_id") -> Column:
        def cut(cuts: list[int]) -> Column:
            return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c <= place(key, self.seed)))

        out = cut(self.bounds[-1])
        for label, cuts in reversed(list(zip(self.order, self.bounds))):
            out = F.when(F.col(label) > 0, cut(cuts)).otherwise(out)
        return out


def _ranges(rows: DataFrame, sums: Sequence[Column], k: int, lack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of ranges of patients and each one's sums, in order. A range in which a border of `lack` lies holds one patient, unless two share a place."""

    def asked(df: DataFrame, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = F.shiftright("__p", shift)
        got = df.groupBy(at.alias("at")).agg(F.count("*").alias("n"), *[s.alias(f"s{i}") for i, s in enumerate(sums)]).collect()  # at most 65,536 for each border
        got = sorted(got, key=lambda r: r[0])
        return np.array([r[0] for r in got], np.int64) << shift, np.array([r[1] for r in got], np.int64), np.array([list(r)[2:] for r in got], float).reshape(len(got), len(sums))

    first, n, mass = asked(rows, LEVELS[0])
    borders = np.cumsum(lack)[:-1] / lack.sum()
    for above, shift in zip(LEVELS, LEVELS[1:]):
        upto = np.cumsum(mass[:, k]) / max(mass[:, k].sum(), 1e-300)
        of = np.unique(np.searchsorted(upto, borders, "left"))
        of = of[of < len(first)]
        of = of[n[of] > 1]
        if not len(of):
            break
        own = F.shiftleft(F.shiftright("__p", above), above).isin([int(x) for x in first[of]])
        finer = asked(rows.where(own), shift)
        keep = np.ones(len(first), bool)
        keep[of] = False
        first, n, mass = (np.concatenate([x[keep], y]) for x, y in zip((first, n, mass), finer))
        order = np.argsort(first)
        first, n, mass = first[order], n[order], mass[order]
    return first, mass


def stratify(patients: DataFrame, labels: Sequence[str], proportions: Sequence[float], seed: int = 42, key: str = "patient_id") -> Stratification:
    """Folds of the given proportions with like shares of every label: the rarest label left is placed first, patients without one last by size.

    patients: one row each with the key, `images` and a count for each label. One job for each label, and up to three small ones over the patients around the
    borders between folds, which lie where each fold has what it still lacks of the label, to half a patient.
    """
    p, share = patients.withColumn("__p", place(key, seed)), np.array(proportions, dtype=float)
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("double") for c in (*labels, "images")]
    total = np.array([float(v) for v in patients.agg(*sums).first()])
    desired, held, left = np.outer(share, total), np.zeros((len(share), len(total))), total.copy()
    order, bounds, rest = [], [], list(range(len(labels)))
    while True:
        rest = [k for k in rest if left[k] > 0]
        k = min(rest, key=lambda i: (left[i], i)) if rest else len(labels)
        rows = p
        for done in order:
            rows = rows.where(F.coalesce(F.col(done), F.lit(0)) == 0)
        rows = rows.where(F.col(labels[k]) > 0) if rest else rows
        lack = np.maximum(desired[:, k] - held[:, k], 0)
        lack = lack if lack.sum() > 0 else share
        at, mass = _ranges(rows, sums, k, lack)
        middle = (np.cumsum(mass[:, k]) - mass[:, k] / 2) / max(mass[:, k].sum(), 1e-300)
        fold = np.searchsorted(np.cumsum(lack)[:-1] / lack.sum(), middle, "right")
        np.add.at(held, fold, mass)
        bounds.append([int(at[fold >= f].min()) if (fold >= f).any() else (1 << BITS) - 1 for f in range(1, len(share))])
        left = left - mass.sum(axis=0)
        if not rest:
            return Stratification(order, bounds, seed)
        order.append(labels[k])


def stratified_folds(patients: DataFrame, labels: Sequence[str], proportions: Sequence[float], seed: int = 42, key: str = "patient_id") -> DataFrame:
    """patients with `fold`, numbered in the order of the proportions. They are written once, as every label is a job over them."""
    patients = stage(patients, "split_patients")
    return patients.withColumn("fold", stratify(patients, labels, proportions, seed, key).fold(key))


def train_val_split(images: DataFrame, patients: DataFrame, labels: Sequence[str], val: float = 0.1, seed: int = 42, key: str = "patient_id", id_col: str = "study_id") -> DataFrame:
    """images with `split`, train or val; all images of a patient on one side.

    Without a patient column, or with fewer than two patients, images are split one by one: the first ones in the order of a hash are val.
    """
    if key not in images.columns or images.select(key).distinct().limit(2).count() < 2:
        held = math.ceil(val * images.count())
        placed = numbered(images, (), [F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), id_col], "image_places", "__place")
        return placed.withColumn("split", F.when(F.col("__place") < held, "val").otherwise("train")).drop("__place")
    side = stratified_folds(patients, labels, [1 - val, val], seed, key).select(key, F.when(F.col("fold") == 0, "train").otherwise("val").alias("split"))
    return images.join(side, key)


def order_shards(counts: np.ndarray, sizes: np.ndarray) -> list[int]:
    """Shards so ordered that each prefix's label shares stay close to those of all, a rare label weighing as much as a common one."""
    target, rest, order = counts.sum(axis=0) / sizes.sum(), list(range(len(sizes))), []
    sum_counts, sum_size = np.zeros(counts.shape[1]), 0.0
    while rest:
        off = np.abs((sum_counts + counts[rest]) / np.maximum(sum_size + sizes[rest], 1)[:, None] - target) / np.maximum(target, 1e-12)
        order.append(rest.pop(int(off.sum(axis=1).argmin())))
        sum_counts, sum_size = sum_counts + counts[order[-1]], sum_size + sizes[order[-1]]
    return order


def nested_subset(images: DataFrame, patients: DataFrame, labels: Sequence[str], n: int, shards: int = 100, seed: int = 42, key: str = "patient_id", id_col: str = "study_id") -> DataFrame:
    """n images, a prefix of one stratified order: smaller subsets lie in larger ones. All images if n is not positive or reaches their number.

    Without a patient column the n first images in the order of a hash.
    """
    if n <= 0 or images.count() <= n:
        return images
    if key not in images.columns:
        return sample_rows(images, n, id_col, seed)
    folds = stratified_folds(patients, labels, [1 / shards] * shards, seed, key)
    rows = folds.groupBy("fold").agg(*[F.sum(c).cast("double").alias(f"s{i}") for i, c in enumerate((*labels, "images"))]).collect()  # a row for each shard
    counts, sizes = np.zeros((shards, len(labels))), np.zeros(shards)
    for r in rows:
        counts[r.fold], sizes[r.fold] = list(r)[1:-1], r[-1]
    placed = stage(images.join(folds.select(key, "fold"), key), "placed_images")
    whole, room = [], n
    for shard in order_shards(counts, sizes):
        if sizes[shard] > room:
            break
        whole, room = [*whole, shard], room - int(sizes[shard])
    out = placed.where(F.col("fold").isin(whole)) if whole else placed.where("false")
    if room:
        part = placed.where(F.col("fold") == shard).withColumn("__b", bucket(id_col, seed))
        per, last = {r[0]: r[1] for r in part.groupBy("__b").count().collect()}, 0  # at most 65,536 buckets
        for last in sorted(per):
            if per[last] > room:
                break
            room -= per[last]
        edge = part.where(F.col("__b") == last).orderBy(id_col).limit(room)
        out = out.unionByName(part.where(F.col("__b") < last).unionByName(edge).drop("__b"))
    return out.drop("fold")


def split_summary(studies: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Size, share without any label, and support of each label for each split. studies: `split` and 0 or 1 for each label."""
    none = F.greatest(F.lit(0), *labels) == 0
    return studies.groupBy("split").agg(F.count("*").alias("n"), F.avg(none.cast("double")).alias("normal"), *[F.sum(c).alias(c) for c in labels])
