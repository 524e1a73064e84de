import os

import pytest

from sparkeval import queries, roundtrips
from sparkeval.bridge import predictions
from sparkeval.queries import SLOW_SQL

QUERIES, ORACLE_SQL = queries.QUERIES | roundtrips.QUERIES, queries.ORACLE_SQL | roundtrips.ORACLE_SQL
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_oracle(name, against_oracle):
    against_oracle(QUERIES[name], ORACLE_SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(SLOW_SQL))
def test_against_slow_sql(name, against_oracle):
    against_oracle(QUERIES[name], SLOW_SQL[name], "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - set(SLOW_SQL)))
def test_without_oracle(name, spark):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_confusion_sweep_takes_every_run(spark):
    val = predictions(spark, FOLDER).where("split = 'val'").groupBy("run_id", "class_idx").count().collect()
    got = QUERIES["confusion_sweep"](spark, FOLDER).groupBy("run_id", "class_idx").sum("n").collect()
    assert {r.run_id for r in val} == {0, 1, 2, 3, 4} and {tuple(r) for r in got} == {tuple(r) for r in val}
