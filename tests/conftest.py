import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def against_oracle(spark):
    """Runs a query and its SQL in DuckDB on a data folder and compares the rows."""
    import duckdb

    def compare(query, sql, folder):
        got = query(spark, folder).toPandas()
        c = duckdb.connect()
        for f in os.listdir(folder):
            c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
        want = c.execute(sql).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert len(got) == len(want) > 0
        a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
        for k in columns:
            same = (a[k] == b[k]) | (a[k].isna() & b[k].isna())
            if str(a[k].dtype).startswith("float"):
                same |= (a[k].astype(float) - b[k].astype(float)).abs() < 2e-6
            assert same.all(), (k, a[~same].head(), b[~same].head())

    return compare
