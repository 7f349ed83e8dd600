from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# Python workers start elsewhere.
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    d = "/root/testdata/sf0.001"
    for f in os.listdir(d):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{d}/{f}'")
    return con


def rows_of(df):
    """Rows as sorted tuples of strings, columns by name."""
    cols = sorted(df.columns)
    return sorted(str(tuple(r[c] for c in cols)) for r in df.collect())


def rows_of_sql(con, sql):
    got = con.sql(sql)
    names = list(got.columns)
    order = [names.index(c) for c in sorted(names)]
    return sorted(str(tuple(r[i] for i in order)) for r in got.fetchall())
