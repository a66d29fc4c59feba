import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.driver.memory", "4g")
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    from tariffloom.session import ship

    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def oracle(sql, sf):
    """DuckDB's rows over the same tables."""
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con.sql(sql).df()


def rows_of(frame):
    """Rows as comparable tuples, columns sorted by name."""
    import datetime
    import decimal
    import math

    import numpy as np
    import pandas as pd

    def plain(v):
        if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        if isinstance(v, (decimal.Decimal, np.integer, int)):
            return float(v)
        if isinstance(v, (datetime.date, pd.Timestamp)):
            return str(v)[:10]
        return tuple(map(plain, v)) if isinstance(v, (list, np.ndarray)) else v

    return sorted(str(tuple(plain(x) for x in r)) for r in frame[sorted(frame.columns)].itertuples(index=False))
