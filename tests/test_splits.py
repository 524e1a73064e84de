import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkeval import splits

LABELS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def pool(spark):
    rng, rows = np.random.default_rng(1), []
    for p in range(3000):
        marks = (rng.random(3) < [0.4, 0.1, 0.01]).astype(int).tolist()
        rows += [(len(rows) + i, p, *marks) for i in range(int(rng.integers(1, 4)))]
    images = spark.createDataFrame(rows, "study_id long, patient_id long, a int, b int, c int")
    return images, images.groupBy("patient_id").agg(F.count("*").alias("images"), *[F.sum(c).alias(c) for c in LABELS])


def test_folds_share_labels_in_proportion(pool):
    images, patients = pool
    folds = splits.stratified_folds(patients, LABELS, [0.7, 0.2, 0.1]).toPandas()
    assert len(folds) == 3000 and set(folds.fold) == {0, 1, 2}
    sums = folds.groupby("fold")[["images", *LABELS]].sum()
    shares = (sums / sums.sum()).to_numpy()
    assert np.abs(shares - np.array([[0.7], [0.2], [0.1]])).max() < 0.03
    assert np.abs(shares[:, :2] - np.array([[0.7], [0.2], [0.1]])).max() < 0.01


def test_patients_stay_on_one_side(pool):
    got = splits.train_val_split(*pool, LABELS, 0.1)
    assert got.count() == pool[0].count()
    assert got.groupBy("patient_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_subsets_are_nested_and_exact(pool):
    images, patients = pool
    small, large = ({r.study_id for r in splits.nested_subset(images, patients, LABELS, n, 20).collect()} for n in (333, 1500))
    assert len(small) == 333 and len(large) == 1500 and small < large
    assert splits.nested_subset(images, patients, LABELS, 0).count() == splits.nested_subset(images, patients, LABELS, 10**6).count() == images.count()
    share = images.where(F.col("study_id").isin(list(large))).agg(F.avg("b")).first()[0]
    assert abs(share / images.agg(F.avg("b")).first()[0] - 1) < 0.1


def test_empty_pool(pool):
    images, patients = pool
    assert splits.stratified_folds(patients.where("false"), LABELS, [0.5, 0.5]).count() == 0


def sequential(patients, share):
    """Patients one after another, largest first, the rarest label left first, each to the fold that lacks most of the label; those without any last by size."""
    counts = np.array([p[1:] for p in patients], float)
    desired, held, left = np.outer(share, counts.sum(axis=0)), np.zeros((len(share), counts.shape[1])), set(range(len(patients)))
    fold = {}
    while left:
        sums = counts[sorted(left)].sum(axis=0)
        rest = [k for k in range(counts.shape[1] - 1) if sums[k] > 0]
        k = min(rest, key=lambda i: (sums[i], i)) if rest else counts.shape[1] - 1
        own = [i for i in left if counts[i, k] > 0 or not rest]
        for i in sorted(own, key=lambda i: (-counts[i, k], i)):
            f = int((desired[:, k] - held[:, k]).argmax())
            held[f] += counts[i]
            fold[patients[i][0]] = f
        left -= set(own)
    return held


@pytest.mark.parametrize("buckets", [16, 47])
def test_folds_meet_their_targets_to_a_patient(spark, buckets, monkeypatch):
    """Of the rarest label, which is cut first, each fold has its target to a patient; of the others it is about as close as placing patients one by one. Few and wide ranges
    at first (16 bits less) are divided until the border is found, with the same result."""
    rng = np.random.default_rng(6)
    patients = [(i, int(rng.random() < 0.05) * int(rng.integers(1, 4)), int(rng.random() < 0.2) * int(rng.integers(1, 6)), int(rng.random() < 0.4)) for i in range(600)]
    patients = [(*p, max(1, sum(p[1:]) + int(rng.integers(0, 3)))) for p in patients]
    df = spark.createDataFrame(patients, "patient_id long, a int, b int, c int, images int")
    share = [0.7, 0.1, 0.2]
    monkeypatch.setattr(splits, "LEVELS", (63 - (63 - buckets) // 4, buckets, 15, 0))
    placed = splits.stratified_folds(df, ["a", "b", "c"], share).collect()
    counts, targets = np.array([p[1:] for p in patients], float), np.outer(share, np.array([p[1:] for p in patients]).sum(axis=0))
    held = np.zeros((3, 4))
    for r in placed:
        held[r.fold] += [r.a, r.b, r.c, r.images]
    assert np.abs(held[:, 0] - targets[:, 0]).max() <= counts[:, 0].max()
    one_by_one = np.abs(sequential(patients, share) - targets)
    assert (np.abs(held - targets)[:, 1:3] <= one_by_one[:, 1:3] + 2 * counts[:, 1:3].max(axis=0)).all()
    monkeypatch.undo()
    assert {r.patient_id: r.fold for r in placed} == {r.patient_id: r.fold for r in splits.stratified_folds(df, ["a", "b", "c"], share).collect()}
