import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL over the smallest tables, as sets of rows with rounded numbers."""
    def plain(v):
        if v is None or v != v:
            return "-"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    def check(query, sql):
        got, asked = query(spark, SMALL), duck.sql(sql)
        names = sorted(got.columns)
        assert names == sorted(asked.columns)
        ours = sorted(tuple(plain(row[n]) for n in names) for row in got.collect())
        at = [asked.columns.index(n) for n in names]
        theirs = sorted(tuple(plain(row[i]) for i in at) for row in asked.fetchall())
        assert ours == theirs

    return check
