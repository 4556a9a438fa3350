import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _cell(x):
    import pandas as pd

    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return "NULL"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="session")
def same():
    """Asserts that two pandas frames hold the same columns and rows, in any order."""

    def check(got, want):
        assert sorted(got.columns) == sorted(want.columns)
        rows = lambda f: sorted(tuple(map(_cell, r)) for r in f[sorted(f.columns)].itertuples(index=False, name=None))
        assert rows(got) == rows(want)

    return check
