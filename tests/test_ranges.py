"""Ranges of scores in the bootstrap: rows are dealt once as short arrays, with their patients' numbers from the study."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkeval import bootstrap, draws, queries
from sparkeval.staging import stage

FOLDER = "/root/testdata/sf0.001"
KEYS = ["draw", "run_id", "class_idx"]


@pytest.fixture(scope="module")
def numbered(spark):
    fired, slots = queries._numbered_fired(spark, FOLDER)
    return stage(fired.where("run_id < 2 AND class_idx < 3").withColumn("score", F.round("score", 2)), "fired"), slots


def _equal(got, want, keys):
    a, b = (df.orderBy(*keys).toPandas() for df in (got, want))
    assert len(a) == len(b) > 0
    for c in a.columns:
        assert a[c].equals(b[c]) or np.allclose(a[c].astype(float), b[c].astype(float), atol=1e-9, equal_nan=True), c


def test_several_ranges_a_key(numbered, monkeypatch):
    fired, slots = numbered
    one = [stage(x, "one") for x in (bootstrap.bootstrap_rank(fired, 130), bootstrap.bootstrap_thresholds(fired, "f1", 130), bootstrap.bootstrap_gaps(fired, 130))]
    monkeypatch.setattr(bootstrap, "CHUNK_ROWS", 90)
    monkeypatch.setattr(bootstrap, "MARKED", 2)
    seen, write = [], bootstrap.stage
    monkeypatch.setattr(bootstrap, "stage", lambda df, name: seen.append((name, write(df, name))) or seen[-1][1])
    several = bootstrap.bootstrap_rank(fired, 130, slots=slots), bootstrap.bootstrap_thresholds(fired, "f1", 130, slots=slots), bootstrap.bootstrap_gaps(fired, 130, slots=slots)
    ranges = [df for name, df in seen if name == "draw_ranges"]
    assert len(ranges) == 3
    for df in ranges:  # a score lies in one range, and no row is lost
        parts = df.select("key", "part", F.explode("score").alias("score")).distinct().groupBy("key", "score").count()
        assert df.agg(F.max("part")).first()[0] >= 3 and parts.agg(F.max("count")).first()[0] == 1
    assert ranges[0].agg(F.sum(F.size("slot"))).first()[0] == fired.count()
    for got, want, keys in zip(several, one, (KEYS, KEYS, ["draw", "run_id", "axis", "level"])):
        _equal(got, want, keys)


def test_rows_with_slots_meet_no_patients(numbered):
    """Neither rows with scores nor levels are joined by patient or laid out by axis before they are dealt."""
    fired, slots = numbered
    plan = bootstrap._packed(fired, None, ("run_id", "class_idx"))._jdf.queryExecution().explainString(fired.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "Join" not in plan and "Exchange" not in plan
    assert slots.count() == fired.agg(F.max("slot")).first()[0] + 1


def test_a_leaf_is_dealt_by_the_same_bits():
    """Read as numbers at once, a leaf's random bytes are those of Generator.bytes."""
    n, leaf, block = draws.FLAT + 5 * draws.LEAF, 3, 1
    drawn = draws._leaf_count(n, leaf, block, 17)
    raw = np.random.Generator(np.random.SFC64(np.random.SeedSequence((17, block, leaf, 0, 1)))).bytes(2 * int(drawn.sum()))
    patient = np.frombuffer(raw, np.uint16) % draws.LEAF
    want = np.zeros((draws.LEAF, draws.WIDE), int)
    np.add.at(want, (patient, np.repeat(np.arange(draws.BLOCK_DRAWS), drawn)), 1)
    assert (draws.leaf_table(n, leaf, block, 17) == want).all()


def test_sums_without_times():
    rng = np.random.default_rng(5)
    w = rng.integers(0, 9, (300, draws.WIDE)).astype(np.uint8)
    step = np.sort(rng.integers(0, 50, 3 * bootstrap.PIECE_ROWS))
    at = rng.integers(0, 300, len(step)).astype(np.int32)
    assert (bootstrap._summed(w, 8, at, None, step, 50) == bootstrap._summed(w, 8, at, np.ones(len(at), np.int32), step, 50)).all()
