from __future__ import annotations

import random
import zlib
from collections import defaultdict

import pytest

from tidelens.llm import sharding
from tidelens.llm.sharding import Cutter, assign_shards


def brute_cuts(sizes, shards):
    """The least capacity by trying, and the greedy cuts."""

    def fill(capacity):
        ends, at, total = [], 0, 0
        for s in sizes:
            if s > capacity:
                return None
            if at + s > capacity:
                ends.append(total)
                at = 0
            at += s
            total += s
        ends.append(total)
        return ends if len(ends) <= shards else None

    low, high = 1, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fill(middle) else (middle + 1, high)
    ends = fill(low)
    return ends + [ends[-1]] * (shards - len(ends))


@pytest.mark.parametrize("seed", range(30))
def test_cutter(seed, monkeypatch):
    monkeypatch.setattr(sharding, "KNOTS", 4)
    random.seed(seed)
    sizes = [random.choice([1, 2, 7, random.randint(1, 1000)]) for _ in range(random.randint(1, 400))]
    if seed % 5 == 0:
        sizes[random.randrange(len(sizes))] = sum(sizes)
    ends, at = [], 0
    for s in sizes:
        ends.append(at := at + s)

    def look(gaps, parts):
        out = []
        for a, b in gaps:
            found = defaultdict(list)
            for e in ends:
                if a < e < b:
                    found[(e - a) * parts // (b - a)].append(e)
            out += [(x[0], x[-1], len(x)) for x in found.values()]
        return out

    assert Cutter(ends[-1], 16, look).cuts() == brute_cuts(sizes, 16)


def check(rows, got, shards):
    assert sorted((d is not None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows) == sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in got)
    first, size = {}, defaultdict(int)
    for d, t in rows:
        t = t or ""
        first[t] = min(first.get(t, (1, 0)), (0, 0) if d is None else (1, d)) if t in first else ((0, 0) if d is None else (1, d))
        size[t] += len(t.encode()) + 1
    slots, load, where = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        where[r.size, r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    ends = brute_cuts([size[t] for t in sorted(first, key=lambda t: first[t])], shards)
    assert [load[s] for s in range(shards)] == [b - a for a, b in zip([0, *ends], ends)]


def test_documents(spark):
    random.seed(4)
    texts = ["é" * random.randint(0, 300) + str(i) for i in range(300)]
    rows = [(i, random.choice(texts)) for i in range(1000)] + [(2000 + i, "hot") for i in range(500)]
    random.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int").repartition(5)
    check(rows, assign_shards(docs).collect(), 16)


def test_odd_rows(spark):
    rows = [(1, "a"), (1, "a"), (5, None), (6, ""), (7, "long " * 9000)]
    check(rows, assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect(), 3)
    assert len(assign_shards(spark.createDataFrame([(None, "x"), (None, None)], "doc_id long, text string"), 3).collect()) == 2
    assert assign_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_large_group_of_repeated_rows(spark):
    rows = [(7, "one same text")] * 2000 + [(100 + i, f"text {i}") for i in range(500)]
    got = assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4).collect()
    assert len(got) == 2500 and len({r.shard for r in got if r.doc_id == 7}) == 1
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
