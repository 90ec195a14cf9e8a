import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
    }
    session = SparkSession.builder.master("local[4]").appName("tests").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    return con


def plain(rows, columns):
    """Rows as comparable texts, whatever numbers' types are."""

    def value(x):
        if x is None or x != x:
            return None
        if hasattr(x, "tolist"):
            x = x.tolist()
        if hasattr(x, "isoformat"):
            return x.isoformat()
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted(repr([value(r[c]) for c in columns]) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    def check(name, query, sql):
        got = query(spark, SMALL)
        want = duck.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns), name
        rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
        assert plain([r.asDict() for r in got.collect()], columns) == plain(rows, columns), name

    return check
