import datetime
import decimal
import sys
import tempfile
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent.parent))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def _value(v):
    if v is None or (isinstance(v, (float, np.floating)) and np.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.number, decimal.Decimal)):
        return round(float(v), 5)
    return str(v) if isinstance(v, datetime.datetime) else v


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(_value, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def same(duck):
    """Whether a DataFrame has the rows of a SQL text, whatever their order."""

    def check(df, sql):
        a, b = df.toPandas(), duck.execute(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        x, y = rows_of(a), rows_of(b)
        assert len(x) == len(y)
        for p, q in zip(x, y):
            assert all(u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 2e-5) for u, v in zip(p, q)), (p, q)

    return check
