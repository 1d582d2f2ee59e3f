import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", f"file://{shared}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _value(x):
    if isinstance(x, float):
        return repr(round(x, 9) + 0.0)
    return bytes(x).hex() if isinstance(x, (bytes, bytearray)) else str(x)


def same_rows(spark, query, sql, sf_dir=SF):
    """Whether a query and its SQL give the same rows, whatever their order."""
    import duckdb

    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted(tuple(_value(r[c]) for c in names) for r in df.collect())
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    found = con.sql(sql)
    cols = found.columns
    theirs = sorted(tuple(_value(dict(zip(cols, r))[c]) for c in names) for r in found.fetchall())
    assert sorted(cols) == names
    assert ours == theirs
    return len(ours)
