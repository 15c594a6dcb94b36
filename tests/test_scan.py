"""Smoothing against pandas: gaps, many series, and series of many slices."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelens.operators.scan import ewm, smooth, wilder


def series(n, seed, gaps=0.2, lead=0):
    random.seed(seed)
    return [None if i < lead or random.random() < gaps else 100 + random.gauss(0, 5) for i in range(n)]


def expected(values, alpha):
    return pd.Series(values, dtype=float).ewm(alpha=alpha, adjust=False).mean().tolist()


def same(got, want):
    assert len(got) == len(want)
    assert np.allclose([np.nan if x is None else x for x in got], want, rtol=1e-12, atol=1e-12, equal_nan=True)


@pytest.mark.parametrize("rows", [1 << 16, 7, 1])
def test_against_pandas_with_gaps(spark, rows):
    own = {"a": series(300, 1), "b": series(150, 2, 0.6, 9), "c": [None] * 5, "d": [3.0], "e": series(64, 3, 0), "f": [None, 1.0, float("nan"), 2.0, None]}
    data = [(k, date(2020, 1, 1) + timedelta(days=i * (1 + i % 3)), x, i) for k, v in own.items() for i, x in enumerate(v)]
    # Days as they are would repeat where steps shrink: number them.
    data = [(k, date(2020, 1, 1) + timedelta(days=i), x, i) for k, _, x, i in data]
    random.shuffle(data)
    df = spark.createDataFrame(data, "ticker string, date date, close double, _row int").repartition(3)
    found = smooth(df, {"fast": ("close", 0.4), "slow": ("close", 0.05)}, rows=rows)
    assert found.columns == [*df.columns, "fast", "slow"]
    got = found.orderBy("ticker", "date").collect()
    for k, v in own.items():
        for name, alpha in (("fast", 0.4), ("slow", 0.05)):
            same([r[name] for r in got if r.ticker == k], expected([np.nan if x is None else x for x in v], alpha))


def test_uneven_times_and_chains(spark):
    """A series that is dense at one time only, and an average of averages."""
    n = 400
    times = sorted(datetime(2020, 1, 1) + timedelta(seconds=(i if i < 300 else i * i)) for i in range(n))
    x = series(n, 5)
    df = spark.createDataFrame([("k", t, v) for t, v in zip(times, x)], "ticker string, date timestamp, close double")
    first = smooth(df, {"a": ("close", 0.2)}, rows=30)
    both = smooth(first, {"b": ("a", 0.5)}, rows=30).orderBy("date").collect()
    want = expected([np.nan if v is None else v for v in x], 0.2)
    same([r.a for r in both], want)
    same([r.b for r in both], expected(want, 0.5))


def test_no_python_and_many_tasks(spark):
    df = spark.range(200_000).select(F.lit("one").alias("ticker"), F.timestamp_seconds("id").alias("date"), (F.col("id") % 97).cast("double").alias("close"))
    found = smooth(df, {"y": ("close", 0.1)}, rows=5_000)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "Arrow" not in plan
    used = found.select("y", F.spark_partition_id().alias("p")).groupBy("p").count().filter("count > 0").count()
    assert used > 1
    last = found.orderBy(F.desc("date")).first().y
    assert last == pytest.approx(expected([float(i % 97) for i in range(200_000)], 0.1)[-1], rel=1e-12)


def test_spans_and_wilder(spark):
    x = series(60, 8)
    df = spark.createDataFrame([("k", date(2020, 1, 1) + timedelta(days=i), v) for i, v in enumerate(x)], "ticker string, date date, close double")
    clean = [np.nan if v is None else v for v in x]
    same([r.y for r in ewm(df, {"y": ("close", 12)}).orderBy("date").collect()], pd.Series(clean).ewm(span=12, adjust=False).mean().tolist())
    same([r.y for r in wilder(df, {"y": ("close", 14)}).orderBy("date").collect()], expected(clean, 1 / 14))
    assert ewm(df.limit(0), {"y": ("close", 3)}).count() == 0


@pytest.mark.parametrize("rows", [1 << 16, 9])
def test_average_of_an_excess(spark, rows):
    x = series(120, 11)
    df = spark.createDataFrame([("k", date(2020, 1, 1) + timedelta(days=i), v) for i, v in enumerate(x)], "ticker string, date date, close double")
    found = smooth(df, {"fast": ("close", 0.4), "slow": ("close", 0.1)}, rows=rows, gaps={"signal": ("fast", "slow", 0.3)})
    assert found.columns == ["ticker", "date", "close", "fast", "slow", "signal"]
    clean = pd.Series([np.nan if v is None else v for v in x])
    over = clean.ewm(alpha=0.4, adjust=False).mean() - clean.ewm(alpha=0.1, adjust=False).mean()
    same([r.signal for r in found.orderBy("date").collect()], over.ewm(alpha=0.3, adjust=False).mean().tolist())
