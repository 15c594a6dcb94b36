from __future__ import annotations

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.test_queries import rows_of
from tidelens.plans.streams import QUERIES, SQL


@pytest.fixture(scope="module")
def many_files(tmp_path_factory):
    """Five days of events in 24 files, which are read in no order of time or id."""
    root = tmp_path_factory.mktemp("many")
    source = duckdb.connect()
    events = source.execute("select i::bigint as event_id, timestamp '2024-01-01' + i * interval 90 second as ts, (i * 7 % 40)::bigint as user_id, 'k' || (i % 3) as event_type, (i * 0.25)::double as value, '{}' as props from range(4800) t(i)").to_arrow_table()
    events = events.set_column(1, "ts", events["ts"].cast(pa.timestamp("us")))
    order = list(range(24))
    random.Random(4).shuffle(order)
    (root / "events.parquet").mkdir()
    for name, part in enumerate(order):
        pq.write_table(events.slice(part * 200, 200), root / "events.parquet" / f"part-{name:04}.parquet")
    return root


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_many_files_in_no_order(spark, many_files, name):
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from read_parquet('{many_files}/events.parquet/*')")
    found = QUERIES[name](spark, str(many_files))
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    own, theirs = [tuple(r) for r in found.collect()], result.fetchall()
    assert sorted(found.columns) == sorted(names)
    assert len(own) == len(theirs)
    assert rows_of(found.columns, own) == rows_of(names, theirs)


def test_upserts_over_batches_out_of_order(spark, many_files, tmp_path):
    """Seven events a batch of files, newest not last: the greatest id of each user stays, and a batch that is run again changes nothing."""
    from pyspark.sql import functions as F

    from tidelens.streaming import events as ev

    folder = str(tmp_path / "table")
    write, seen = ev.upsert_to(folder, ["user_id"], F.desc("event_id")), []

    def batch(df, number):
        newest = df.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))
        write(newest, number)
        if number == 2:
            write(newest, number)
        seen.append(number)

    stream = ev.read(spark, f"{many_files}/events.parquet", files_at_once=5)
    stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    assert len(seen) == 5
    got = {r.user_id: (r.event_id, r.value) for r in spark.read.parquet(f"{folder}/v4").collect()}
    want = {}
    for i in range(4800):
        want[i * 7 % 40] = (i, i * 0.25)
    assert got == want


def test_late_rows_are_left_out(spark, tmp_path):
    """Four batches. A batch's rows are late against the watermark that closed bars in the batch before; a repeated id counts once."""
    from datetime import datetime

    from pyspark.sql import functions as F

    from tidelens.streaming import events as ev

    at = lambda h, m: datetime(2024, 1, 1, h, m)
    batches = [[(1, at(1, 5), 1.0), (2, at(2, 30), 2.0)], [(3, at(2, 25), 3.0), (2, at(2, 30), 2.0), (5, at(5, 0), 5.0)], [(6, at(5, 20), 6.0), (4, at(1, 50), 4.0), (8, at(2, 40), 8.0)], [(9, at(2, 45), 9.0), (7, at(9, 0), 7.0)]]
    for rows in batches:
        table = spark.createDataFrame([(e, ts, 1, "k", v, "{}") for e, ts, v in rows], ev.EVENTS).coalesce(1)
        table.write.mode("append").parquet(str(tmp_path / "in"))

    def run(name, out):
        folder = str(tmp_path / name)
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{folder}/out")

    bars = {r.start.hour: (r.open, r.high, r.close, r.n) for r in run("bars", ev.bars(ev.read(spark, str(tmp_path / "in"), files_at_once=1))).collect()}
    assert bars[1] == (1.0, 1.0, 1.0, 1)  # event 4 came after its hour was closed
    assert bars[2] == (3.0, 8.0, 8.0, 4)  # events 3 and 8 were in time, event 9 wasn't; the copy of event 2 counts here
    once = run("once", ev.once(ev.read(spark, str(tmp_path / "in"), files_at_once=1)).select("event_id"))
    assert once.filter(F.col("event_id") == 2).count() == 1
