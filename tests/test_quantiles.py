"""Quantiles by counting against those of whole groups."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelens.functions import ranks
from tidelens.operators import panel, quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def rows(seed=2):
    random.seed(seed)
    out = [("even", float(i)) for i in range(1000)] + [("ties", random.choice([1.0, 2.0, 2.0, 7.5])) for _ in range(800)]
    out += [("wide", random.choice([-1, 1]) * 10.0 ** random.randint(-300, 300)) for _ in range(500)] + [("one", 3.25), ("two", 1.0), ("two", 2.0), ("none", None), ("nan", float("nan")), ("nan", 4.0), (None, 5.0), (None, 6.0)]
    out += [("same", 9.0)] * 300
    random.shuffle(out)
    return out


@pytest.mark.parametrize("accuracy", [100_000, 50, 7])
def test_against_numpy(spark, accuracy):
    df = spark.createDataFrame(rows(), "g string, x double").repartition(4)
    got = {r.g: r.q for r in quantiles.quantiles(df, "x", ["g"], SHARES, accuracy).collect()}
    held = {}
    for g, x in rows():
        if x is not None and x == x:
            held.setdefault(g, []).append(x)
    assert got.keys() == held.keys()
    for g, x in held.items():
        assert np.allclose(got[g], np.quantile(x, SHARES), rtol=1e-12, atol=0)
    whole = quantiles.quantiles(df.filter("g in ('even', 'ties')"), "x", [], [0.5], accuracy).first().q
    assert whole == [pytest.approx(np.median(held["even"] + held["ties"]))]


def test_same_as_windows(spark):
    random.seed(8)
    data = [(i % 6, i % 2, None if random.random() < 0.1 else random.gauss(0, 1) ** 3) for i in range(1500)]
    d = spark.createDataFrame(data, "date int, s int, x double").withColumn("i", F.monotonically_increasing_id())
    of = lambda df, c: {r.i: r[c] for r in df.collect()}
    assert of(quantiles.winsorise_mad(d, "x", ["date", "s"]), "x") == pytest.approx(of(panel.winsorise_mad(d, "x", ["date", "s"]), "x"))
    assert of(quantiles.impute(d, "x", ["date"]), "x") == pytest.approx(of(d.withColumn("x", ranks.impute("x", "date")), "x"))
    edges = d.withColumn("e", ranks.qcut_edges("x", 5, "date"))
    assert of(quantiles.qcut(d, "x", 5, ["date"], "b"), "b") == of(edges.withColumn("b", ranks.bin_of("x", "e")), "b")
    assert quantiles.winsorise_mad(d.limit(0), "x", ["date"]).count() == 0


def test_little_is_left_of_a_large_group(spark):
    """Of a million values only those near the quantile are ordered."""
    df = spark.range(1_000_000).select(F.lit(1).alias("g"), ((F.col("id") * 7919) % 1_000_003).cast("double").alias("x"))
    found = quantiles.quantiles(df, "x", ["g"], [0.5], 1000)
    exact = np.median((np.arange(1_000_000, dtype=np.int64) * 7919) % 1_000_003)
    assert found.first().q == [exact]
