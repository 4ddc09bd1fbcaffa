from __future__ import annotations

import math
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, list):
        return [_plain(v) for v in x]
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


@pytest.fixture(scope="session")
def same():
    """Whether a DataFrame and DuckDB SQL over the tables give the same rows, in any order."""

    def check(df, sql, data=DATA):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(names)
        theirs = sorted(repr([_plain(r[names.index(c)]) for c in order]) for r in got.fetchall())
        ours = sorted(repr([_plain(r[c]) for c in order]) for r in df.collect())
        assert ours == theirs

    return check
