"""A backlog in any order, admitted in order of time."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.test_streams import many_files  # noqa: F401
from tidelens.streaming import admission
from tidelens.streaming import events as ev

T0, MINUTE = datetime(2024, 1, 1), timedelta(minutes=1)


def test_groups_leave_nothing_behind():
    random.seed(6)
    for _ in range(200):
        spans = []
        for i in range(random.randint(0, 30)):
            a = T0 + random.randrange(2000) * MINUTE
            spans.append((f"f{i}", a, a + random.randrange(200) * MINUTE))
        late, least = random.randrange(30) * MINUTE, random.randint(1, 5)
        groups = admission.in_order(spans, late, least)
        of = {s[0]: s for s in spans}
        assert sorted(f for g in groups for f in g) == sorted(of)
        assert all(len(g) >= least for g in groups[:-1])
        for i in range(1, len(groups)):
            reach = max(of[f][2] for g in groups[:i] for f in g)
            assert all(of[f][1] >= reach - late for g in groups[i:] for f in g)


def test_bars_over_several_batches(spark, many_files, tmp_path):  # noqa: F811
    """24 files in no order: several batches, no bar lost, and a state that doesn't grow with the backlog."""
    spans = admission.file_spans(spark, f"{many_files}/events.parquet", ev.EVENTS)
    groups = admission.in_order(spans, 10 * MINUTE, least=4)
    assert len(spans) == 24 and len(groups) == 6
    states = []

    def start(stream):
        out = ev.bars(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        return out.queryName(f"bars{len(states)}_{random.random()}".replace(".", ""))

    class Watch:
        """Counts the rows of state after each group."""

        def __init__(self, writer):
            self.writer = writer

        def trigger(self, **how):
            self.writer = self.writer.trigger(**how)
            return self

        def start(self):
            self.query = self.writer.start()
            return self

        def awaitTermination(self):
            self.query.awaitTermination()
            states.append(self.query.lastProgress["stateOperators"][0]["numRowsTotal"])

    admission.run_in_order(spark, groups, ev.EVENTS, lambda stream: Watch(start(stream)))
    got = spark.read.parquet(str(tmp_path / "out"))
    closed = [i for i in range(4800) if T0 + timedelta(seconds=90 * i) < T0 + timedelta(hours=(4799 * 90 - 600) // 3600)]
    assert got.agg(F.sum("n")).first()[0] == len(closed)
    assert got.groupBy("start", "event_type").count().filter("count > 1").count() == 0
    assert len(states) == 6 and max(states) <= 9


def test_files_in_several_folders(spark, tmp_path):
    for i, name in enumerate(["a/one", "b/two", "b/three, four"]):
        spark.createDataFrame([(i, T0 + i * MINUTE, 1, "k", 1.0, "{}")], ev.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    spans = admission.file_spans(spark, f"{tmp_path}/in/*/*", ev.EVENTS)
    seen = []
    folder = str(tmp_path / "state")
    start = lambda s: s.writeStream.option("checkpointLocation", folder).foreachBatch(lambda df, n: seen.extend(r.event_id for r in df.collect()))
    admission.run_in_order(spark, admission.in_order(spans, MINUTE), ev.EVENTS, start)
    assert sorted(seen) == [0, 1, 2]
