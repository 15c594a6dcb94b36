"""Bootstrap: counts that add up, draws spelled out one by one, and an order of rows that doesn't matter."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelens.operators import bootstrap


def rows(n=900, seed=3):
    random.seed(seed)
    return [(f"t{i}", random.choice([1, -1]), round(random.gauss(0.01, 0.1), 6)) for i in range(n)]


def test_shares_add_up_and_are_multinomial():
    sizes = np.array([5, 0, 70, 25, 100, 1])
    found = np.stack([bootstrap.shares(sizes, b, 4000, 9) for b in range(6)])
    assert (found.sum(0) == sizes.sum()).all() and (found[1] == 0).all()
    p = sizes / sizes.sum()
    assert found.mean(1) == pytest.approx(sizes, rel=0.1, abs=0.1)
    assert found.var(1) == pytest.approx(sizes.sum() * p * (1 - p), rel=0.15, abs=0.1)
    assert np.cov(found[2], found[4])[0, 1] == pytest.approx(-sizes.sum() * p[2] * p[4], rel=0.2)


@pytest.mark.parametrize("size", [50_000, 200])
def test_against_draws_one_by_one(spark, size):
    own, times, seed = rows(), 30, 7
    df = spark.createDataFrame(own, "id string, side int, y double")
    got = {r.resample: r.spread for r in bootstrap.spreads(df.repartition(5), "side", "y", "id", times, seed, size).collect()}
    assert got == {r.resample: r.spread for r in bootstrap.spreads(df.coalesce(1), "side", "y", "id", times, seed, size).collect()}
    blocks = -(-len(own) // size)
    of = {r.id: r.b for r in df.select("id", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b")).collect()}
    parts = [sorted(r for r in own if of[r[0]] == b) for b in range(blocks)]
    sizes = np.array([len(p) for p in parts])
    drawn = [[] for _ in range(times)]
    for b, part in enumerate(parts):
        rng = np.random.default_rng([seed, b])
        for t, n in enumerate(bootstrap.shares(sizes, b, times, seed)):
            drawn[t] += [part[i] for i in rng.integers(0, len(part), n)]
    for t in range(times):
        assert len(drawn[t]) == len(own)
        mean = lambda s: sum(y for _, x, y in drawn[t] if x == s) / sum(x == s for _, x, _ in drawn[t])  # noqa: E731, B023
        assert got[t] == pytest.approx(mean(1) - mean(-1), abs=1e-12)


def test_deviation_is_the_standard_error(spark):
    own = rows(2000, 5)
    found = bootstrap.interval(bootstrap.spreads(spark.createDataFrame(own, "id string, side int, y double"), "side", "y", "id", 500, rows=300)).first()
    a, b = (np.array([y for _, s, y in own if s == k]) for k in (1, -1))
    assert found.mean == pytest.approx(a.mean() - b.mean(), abs=4e-4)
    assert found.deviation == pytest.approx(np.sqrt(a.var() / len(a) + b.var() / len(b)), rel=0.12)
    assert found.low < found.mean < found.high and 0 <= found.positive <= 1


def test_odd_rows(spark):
    d = spark.createDataFrame([("a", 1, 0.5), ("b", 1, None), (None, 1, 0.5)], "id string, side int, y double")
    assert [r.spread for r in bootstrap.spreads(d, "side", "y", "id", 3).collect()] == [None] * 3
    assert bootstrap.interval(bootstrap.spreads(d.limit(0), "side", "y", "id", 3)).first().mean is None
