"""Small cases that the tables don't hold: ties, nulls, gaps, total losses, exact and missing matches."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelens.functions import ranks
from tidelens.functions import windows as w_
from tidelens.operators import joins, panel
from tidelens.sources import readers, writers


def series(spark, values, name="x"):
    return spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], f"ticker string, date int, {name} double")


def values(df, name):
    return [None if r[0] is None else round(r[0], 6) for r in df.orderBy("date").select(name).collect()]


def test_ranks_with_ties_and_null(spark):
    d = series(spark, [1.0, 2.0, 2.0, 4.0, None]).withColumn("p", ranks.pct_rank("x", "ticker"))
    assert values(d, "p") == [0.25, 0.625, 0.625, 1.0, None]


def test_bins_with_ties(spark):
    d = series(spark, [1.0, 1.0, 1.0, 1.0, 2.0, 3.0]).withColumn("e", ranks.qcut_edges("x", 5, "ticker")).withColumn("b", ranks.bin_of("x", "e").cast("double"))
    assert values(d, "b") == [0, 0, 0, 0, 1, 2]


def test_change_over_a_gap(spark):
    d = series(spark, [1.0, None, 2.0, 3.0]).withColumn("c", w_.change("x", w_.series()))
    assert values(d, "c") == [None, 0, 1, 0.5]


def test_level_through_a_total_loss(spark):
    d = series(spark, [0.1, -1.0, 0.2]).withColumn("n", w_.nav("x", w_.series()))
    assert values(d, "n") == [1.1, 0, 0]


def test_exponential_average(spark):
    for given, wanted in (([1.0, 2.0, 3.0, 4.0], [1, 1.5, 2.25, 3.125]), ([1.0, None, 2.0, 3.0], [1, 1, 1.666667, 2.333333])):
        found = panel.ewm(series(spark, given), {"e": ("x", 3)})
        assert values(found, "e") == wanted


def test_rsi_of_a_flat_series(spark):
    d = series(spark, [5.0] * 6).withColumn("step", F.col("x") - F.lag("x").over(w_.series()))
    assert values(d.withColumn("r", w_.rsi("step", w_.series(), 3)), "r")[-1] == 100


def test_correlation_of_a_constant_is_null(spark):
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "a double, b double")
    assert d.agg(w_.corr("a", "b")).first()[0] is None
    e = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (None, 9.0), (3.0, 7.0)], "a double, b double")
    assert math.isclose(e.agg(w_.corr("a", "b")).first()[0], 0.993399, abs_tol=1e-6)


def test_asof_exact_tie_and_no_match(spark):
    left = spark.createDataFrame([("a", t) for t in (0, 1, 5, 9)], "k string, t int")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 4, "y")], "k string, u int, v string")
    found = joins.asof(left, right, ["k"], "t", "u", ["v"])
    assert sorted((r["t"], r["v"]) for r in found.collect()) == [(0, None), (1, "x"), (5, "y"), (9, "y")]


def test_clip_at_a_zero_deviation(spark):
    d = spark.createDataFrame([("g", 2.0)] * 3 + [("g", 50.0)], "g string, x double")
    found = panel.winsorise_mad(d, "x", ["g"], out="y")
    assert {r["y"] for r in found.collect()} == {2.0}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, panel.upsert(old, new, ["k"]).select("k", "v").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, panel.upsert(old, new, ["k"], new_wins=False).select("k", "v").collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_files(spark, tmp_path):
    d = spark.createDataFrame([(1, 0.5), (2, None)], "k long, v double")
    writers.json_lines(d, str(tmp_path / "j"))
    writers.json_lines(d, str(tmp_path / "j"))
    assert readers.json_lines(spark, str(tmp_path / "j"), "k long, v double").count() == 4
    writers.parquet(d, str(tmp_path / "p"))
    assert readers.parquet(spark, str(tmp_path / "p"), ["v"]).columns == ["v"]
    (tmp_path / "AAA_price.csv").write_text("Date,Close,High,Low,Open,Volume\n2020-01-02,1,2,0.5,1,10\n")
    assert readers.csv_prices(spark, str(tmp_path / "AAA_price.csv")).count() == 1


def test_ranks_are_per_group(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 9.0)], "g string, x double")
    n = d.select("g", "x", ranks.pct_rank("x", "g").alias("p"), F.count("*").over(Window.partitionBy("g")).alias("n"))
    assert sorted(map(tuple, n.collect())) == [("a", 1.0, 0.5, 2), ("a", 3.0, 1.0, 2), ("b", 9.0, 1.0, 1)]
