from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def events(spark):
    """A small frame of sessions with repeats, ties in time, single events and a long session."""
    rows, i = [], 0
    for s in range(12):
        for k in range(1 if s == 0 else 8 + s):
            ts = 1_700_000_000 + s * 50_000 + (k // 2) * (1 + s) * 900
            rows.append((s, (k * k + 3 * s) % 11, ts, (k + s) % 3, i))
            i += 1
    for k in range(90):
        rows.append((99, (k * 7) % 31, 1_700_000_000 + k * 1000 - (k % 4) * 5, (k * k) % 3, i))
        i += 1
    df = spark.createDataFrame(rows, "session long, aid int, ts long, type int, event_id long")
    return df.repartition(3)


def same(a, b, digits: int = 9) -> None:
    """Both frames hold the same rows, whatever their order."""
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)

    def rows(df):
        out = []
        for r in df.select(*cols).collect():
            out.append(tuple(round(v, digits) if isinstance(v, float) else str(v) for v in r))
        return sorted(out, key=repr)

    assert rows(a) == rows(b)
