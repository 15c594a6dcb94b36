"""Versioned tables: touched buckets only, all or nothing, and batches that run twice."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidelens.sources.versioned import Table

SCHEMA = "k long, day int, v double"


def rows(spark, *own):
    return spark.createDataFrame(own, SCHEMA)


def held(table, version=None):
    return sorted(tuple(r) for r in table.read(version).collect())


def test_one_key_rewrites_one_bucket(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), ["k"], buckets=8, kept=10)
    assert table.read() is None
    table.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("day"), F.lit(0.5).alias("v")))
    before = table.last()["folders"]
    assert len(before) == 8
    assert table.upsert(rows(spark, (7, 2, 9.0))) == 1
    after = table.last()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1
    got = held(table)
    assert len(got) == 200 and (7, 2, 9.0) in got and held(table, 0)[7] == (7, 1, 0.5)


def test_order_decides_and_repeated_batches_do_nothing(spark, tmp_path):
    table, newest = Table(spark, str(tmp_path / "t"), ["k"], buckets=4), F.desc("day")
    table.upsert(rows(spark, (1, 5, 1.0), (1, 4, 2.0), (2, 1, 3.0)), newest, 0)
    table.upsert(rows(spark, (1, 3, 4.0), (3, 3, 5.0)), newest, 1)
    assert held(table) == [(1, 5, 1.0), (2, 1, 3.0), (3, 3, 5.0)]
    version = table.last()["version"]
    assert table.upsert(rows(spark, (1, 9, 7.0)), newest, 1) == version and held(table) == [(1, 5, 1.0), (2, 1, 3.0), (3, 3, 5.0)]
    table.upsert(rows(spark).limit(0), newest, 2)
    assert held(table) == [(1, 5, 1.0), (2, 1, 3.0), (3, 3, 5.0)] and table.last()["batch"] == 2


def test_a_failure_before_the_swap_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = Table(spark, str(tmp_path / "t"), ["k"], buckets=4)
    table.upsert(rows(spark, (1, 1, 1.0), (2, 1, 1.0)))

    def fail(_):
        raise OSError("lost")

    monkeypatch.setattr(table, "_swap", fail)
    with pytest.raises(OSError):
        table.upsert(rows(spark, (1, 2, 2.0)))
    again = Table(spark, str(tmp_path / "t"), ["k"])
    assert held(again) == [(1, 1, 1.0), (2, 1, 1.0)]
    again.upsert(rows(spark, (1, 3, 3.0)))
    assert held(again) == [(1, 3, 3.0), (2, 1, 1.0)]


def test_two_writers_and_old_versions(spark, tmp_path):
    a = Table(spark, str(tmp_path / "t"), ["k"], buckets=4, kept=1)
    a.upsert(rows(spark, (1, 1, 1.0)))
    stale = a.last() | {"version": 0}
    with pytest.raises(RuntimeError):
        a._swap(stale)
    for i in range(5):
        a.upsert(rows(spark, (i, 1, float(i))))
    assert a.versions() == [5] and held(a) == [(i, 1, float(i)) for i in range(5)]
    folders = set(a.last()["folders"].values())
    on_disk = {f"data/{p.parent.name}/{p.name}" for p in Path(tmp_path / "t" / "data").glob("*/_bucket=*")}
    assert on_disk == folders
