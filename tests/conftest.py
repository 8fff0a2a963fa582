import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{ROOT}/tests:{ROOT}/tests/llm:{os.environ.get('PYTHONPATH', '')}"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    found = builder.config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Run a query and its SQL on the small tables and compare names and rows."""

    def compare(query, sql):
        found = query(spark, SMALL)
        wanted = duck.sql(sql)
        assert sorted(found.columns) == sorted(wanted.columns)
        names = sorted(found.columns)
        rows = sorted(repr(tuple(r[n] for n in names)) for r in found.collect())
        at = [wanted.columns.index(n) for n in names]
        assert rows == sorted(repr(tuple(r[k] for k in at)) for r in wanted.fetchall())

    return compare
