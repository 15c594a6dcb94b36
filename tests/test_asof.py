"""As-of joins against pandas, on keys of one task and on keys cut into slices of time."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelens.operators import joins


def tables(seed=4):
    random.seed(seed)
    t = lambda s: datetime(2021, 1, 1) + timedelta(seconds=s)
    left = [("hot" if i % 3 else f"k{i % 7}", t(random.randrange(40_000)), i) for i in range(3000)]
    right = [("hot", t(s), float(s)) for s in random.sample(range(9_000, 30_000), 500)] + [(f"k{i}", t(s), s + i / 10) for i in range(5) for s in random.sample(range(40_000), 20)]
    return left, right


@pytest.mark.parametrize("rows", [1 << 20, 200, 3])
def test_against_pandas(spark, rows):
    left, right = tables()
    a = spark.createDataFrame(left, "k string, t timestamp, i int").repartition(3)
    b = spark.createDataFrame(right, "k string, u timestamp, v double").repartition(2)
    got = {r.i: r.v for r in joins.asof(a, b, ["k"], "t", "u", ["v"], rows).collect()}
    x, y = pd.DataFrame(left, columns=["k", "t", "i"]).sort_values("t"), pd.DataFrame(right, columns=["k", "u", "v"]).sort_values("u")
    want = pd.merge_asof(x, y, left_on="t", right_on="u", by="k")
    assert got == {i: None if v != v else v for i, v in zip(want.i, want.v)}


@pytest.mark.parametrize("rows", [1 << 20, 100])
def test_one_series_without_keys(spark, rows):
    left, right = tables(5)
    right = {t: v for _, t, v in right}
    a, b = spark.createDataFrame([(t, i) for _, t, i in left], "t timestamp, i int"), spark.createDataFrame(list(right.items()), "u timestamp, v double")
    got = {r.i: r.v for r in joins.asof_scalar(a, b, "t", "u", ["u", "v"], rows).collect()}
    want = pd.merge_asof(pd.DataFrame([(t, i) for _, t, i in left], columns=["t", "i"]).sort_values("t"), pd.DataFrame(sorted(right.items()), columns=["u", "v"]), left_on="t", right_on="u")
    assert got == {i: None if v != v else v for i, v in zip(want.i, want.v)}


def test_one_key_fills_several_tasks(spark):
    a = spark.range(100_000).select(F.lit("one").alias("k"), F.timestamp_seconds(F.col("id") * 3 + 1).alias("t"), "id")
    b = spark.range(0, 300_000, 5_000).select(F.lit("one").alias("k"), F.timestamp_seconds("id").alias("u"), F.col("id").alias("v"))
    found = joins.asof(a, b, ["k"], "t", "u", ["v"], 5_000)
    assert found.filter(F.col("v") != F.floor((F.col("id") * 3 + 1) / 5_000) * 5_000).count() == 0
    assert found.count() == 100_000
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_equal_times_and_numbers(spark):
    a = spark.createDataFrame([(5, 1), (5, 2), (4, 3), (9, 4)], "t int, i int")
    b = spark.createDataFrame([(5, "x"), (7, "y")], "u int, v string")
    for rows in (1, 1 << 20):
        assert {r.i: r.v for r in joins.asof_scalar(a, b, "t", "u", ["v"], rows).collect()} == {1: "x", 2: "x", 3: None, 4: "y"}
    assert joins.asof_scalar(a.limit(0), b, "t", "u", ["v"], 1).count() == 0
    assert [r.v for r in joins.asof_scalar(a, b.limit(0), "t", "u", ["v"], 1).collect()] == [None] * 4
