import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "3g",
        "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    """The smallest tables."""
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def medium():
    return "/root/testdata/sf0.01"


def plain(x):
    """Rows and arrays as tuples, so that they can be compared and sorted."""
    if hasattr(x, "asDict"):
        x = list(x.asDict().values())
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return None if isinstance(x, float) and x != x else bytes(x) if isinstance(x, bytearray) else x


@pytest.fixture(scope="session")
def against_sql():
    """Compares a query with its SQL over a folder of tables."""
    import duckdb

    def check(df, sql, folder, tables=None):
        c = duckdb.connect()
        for name in os.listdir(folder):
            c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
        cols = sorted(df.columns)
        mine = sorted((tuple(plain(r[k]) for k in cols) for r in df.collect()), key=repr)
        r = c.sql(sql)
        at = [r.columns.index(k) for k in sorted(r.columns)]
        assert cols == sorted(r.columns)
        assert mine == sorted((tuple(plain(x[k]) for k in at) for x in r.fetchall()), key=repr)

    return check
