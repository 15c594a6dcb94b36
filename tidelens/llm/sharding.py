"""Sharding: documents in shards of nearly equal bytes, by minimax contiguous partition.

Equal texts are one atomic group. Groups stand in the order of their smallest doc_id; shards are contiguous runs of groups. The
shards' capacity is the smallest with which a greedy fill needs no more than the given shards, found by binary search, and the
greedy fill with that capacity makes the cuts.

The search runs on the driver over knots: some of the groups' ends as running totals, at most about `KNOTS` more with each look. Knots bound each greedy
fill from below and above. Where the bounds differ, the gaps between knots that matter are looked up again more finely in Spark, until the
answer is exact. So the driver holds a bounded number of numbers, however many groups there are.

A group of copies of more than a thousandth of all rows is joined to its place by broadcast, and its rows are sorted over many
tasks, so that no task gets a whole large group.

Defined cases: a null text counts as an empty one. Null doc_ids come first. Repeated rows are copies. A group larger than all
others together still is one group, and is then the capacity. A very long text is only measured and hashed. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm._spark import join_hot, stable, tasks

SHARDS = 16
KNOTS = 1024


class Cutter:
    """Binary search for the smallest capacity; look(gaps, parts) gives the first end, the last end and their number in each part of each gap."""

    def __init__(self, total: int, shards: int, look):
        self.total, self.shards, self.look = total, shards, look
        self.knots, self.gaps = [0, total], {0}  # gaps: knots between which and the next there may be unknown ends

    def step(self, at: int, capacity: int, upper: bool) -> int:
        """A bound of the last end that is at most at + capacity."""
        reach = min(at + capacity, self.total)
        i = bisect_right(self.knots, reach) - 1
        low = self.knots[i]
        return reach if upper and low in self.gaps and low < reach else low

    def path(self, capacity: int, upper: bool) -> list[int]:
        at, out = 0, []
        for _ in range(self.shards):
            at = self.step(at, capacity, upper)
            out.append(at)
        return out

    def least(self, upper: bool) -> int:
        """The smallest capacity whose bound reaches the total."""
        low, high = 0, self.total
        while low < high:
            middle = (low + high) // 2
            if self.path(middle, upper)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def cuts(self) -> list[int]:
        """Running totals at which the shards end."""
        while True:
            sure, hope = self.least(False), self.least(True)
            low, high = self.path(hope, False), self.path(sure, True)
            if sure == hope and low == high:
                return low
            spans = []
            for a, b in sorted(zip(low, high)):
                a = self.knots[bisect_right(self.knots, a) - 1]
                b = self.knots[min(bisect_left(self.knots, b), len(self.knots) - 1)]
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            next_knot = dict(zip(self.knots, self.knots[1:]))
            gaps = [(g, next_knot[g]) for g in sorted(self.gaps) if any(a <= g < b for a, b in spans)]
            found = self.look(gaps, max(2, KNOTS // len(gaps)))
            self.gaps.difference_update(g for g, _ in gaps)
            self.knots = sorted({*self.knots, *(x[0] for x in found), *(x[1] for x in found)})
            for first, last, count in found:
                if count > 2:
                    self.gaps.update(self.knots[bisect_left(self.knots, first) : bisect_left(self.knots, last)])


def _within(gaps: list[tuple[int, int]], parts: int):
    """First, last and number of the ends in each part of each gap, as far as one task sees."""
    low, high = np.array(gaps, np.int64).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(0).to_numpy(zero_copy_only=False)
            gap = np.searchsorted(low, ends, "left") - 1
            inside = (gap >= 0) & (ends < high[gap])
            ends, gap = ends[inside], gap[inside]
            part = ((ends - low[gap]).astype(float) / (high[gap] - low[gap]) * parts).astype(np.int64)
            order = np.argsort(ends, kind="stable")
            ends, key = ends[order], (gap * (parts + 1) + part)[order]
            _, first, count = np.unique(key, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_pydict({"key": pa.array(key[first], pa.int64()), "first": pa.array(ends[first], pa.int64()), "last": pa.array(ends[first + count - 1], pa.int64()), "n": pa.array(count, pa.int64())})

    return run


def _look_up(ends: DataFrame):
    """The same over all tasks: at most KNOTS rows, or two for each gap."""

    def look(gaps: list[tuple[int, int]], parts: int) -> list[tuple[int, int, int]]:
        rows = ends.mapInArrow(_within(gaps, parts), "key long, first long, last long, n long")
        return [tuple(r) for r in rows.groupBy("key").agg(F.min("first"), F.max("last"), F.sum("n")).drop("key").collect()]

    return look


def _running(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index("size")).to_numpy(zero_copy_only=False)
            sums = np.cumsum(sizes) + total
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_pydict({c: batch.column(batch.schema.get_field_index(c)) for c in names} | {"part": pa.array(np.full(len(sums), part, np.int32)), "running": pa.array(sums)})

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        shard = batch.column(batch.schema.get_field_index("shard")).to_numpy(zero_copy_only=False)
        place = np.zeros(len(shard), np.int64)
        for s in np.unique(shard).tolist():
            own = shard == s
            place[own] = seen.get(s, 0) + np.arange(int(own.sum()))
            seen[s] = seen.get(s, 0) + int(own.sum())
        yield pa.RecordBatch.from_pydict({c: batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "size", "text_crc32", "shard")} | {"part": pa.array(np.full(len(shard), part, np.int32)), "place": pa.array(place)})


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs; the law is `bytes`."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    own = F.monotonically_increasing_id().alias("row")  # spreads rows that are alike in all else
    rows = stable(docs.select("doc_id", own, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest")))
    n = tasks(docs)
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"), F.min("doc_id").alias("first"), F.count("*").alias("n"))
    ordered = groups.repartitionByRange(n, "first", "digest").sortWithinPartitions("first", "digest")
    running = stable(ordered.mapInArrow(_running(["digest", "n"]), "digest binary, n long, part int, running long"))
    # One row for each part.
    totals = sorted(tuple(r) for r in running.groupBy("part").agg(F.max("running"), F.sum("n")).collect())
    before, starts, count = 0, [], sum(k for _, _, k in totals)
    for part, size, _ in totals:
        starts.append((part, before))
        before += size
    known = spark.createDataFrame(starts, "part int, part_start long")
    ends = stable(running.join(F.broadcast(known), "part").select("digest", "n", (F.col("part_start") + F.col("running")).alias("end")))
    cuts = Cutter(before, shards, _look_up(ends.select("end"))).cuts() if before else []
    shard = F.lit(0)
    for cut in cuts[:-1]:
        shard = shard + F.when(F.col("end") > F.lit(cut), 1).otherwise(0)
    placed = join_hot(rows, ends, "digest", count).select("doc_id", "row", "size", "text_crc32", "end", shard.cast("int").alias("shard"))
    placed = placed.repartitionByRange(n, "end", "doc_id", "row").sortWithinPartitions("end", "doc_id", "row")
    placed = stable(placed.mapInArrow(_places, "doc_id long, size long, text_crc32 long, shard int, part int, place long"))
    # At most one row for each part and cut.
    filled, offsets = {}, []
    for part, own, count in sorted(tuple(r) for r in placed.groupBy("part", "shard").count().collect()):
        offsets.append((part, own, filled.get(own, 0)))
        filled[own] = filled.get(own, 0) + count
    offset = spark.createDataFrame(offsets, "part int, shard int, slots_before long")
    out = placed.join(F.broadcast(offset), ["part", "shard"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slots_before") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
