"""Registered queries that run a stream over the event files to its end and return what it wrote."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.sources.shared import shared_folder
from tidelens.sources.versioned import Table
from tidelens.streaming import admission
from tidelens.streaming import events as ev

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: How far behind the newest event a row may come, as the streams' watermarks have it.
LATE = timedelta(minutes=10)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str, files_at_once: int | None = 8) -> DataFrame:
    return ev.read(spark, f"{sf_dir}/events.parquet*", files_at_once=files_at_once)


def _run(spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """The rows that an append stream over the events has written when all files are read: they are admitted in order of time, some files a batch."""
    folder = shared_folder(spark, "stream")
    spans = admission.file_spans(spark, f"{sf_dir}/events.parquet", ev.EVENTS)
    kinds = build(spark.createDataFrame([], ev.EVENTS)).schema

    def start(stream: DataFrame):
        return build(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")

    admission.run_in_order(spark, admission.in_order(spans, LATE), ev.EVENTS, start)
    return spark.read.schema(kinds).parquet(f"{folder}/out")


@query("""with b as (select date_trunc('hour', ts) as start, event_type, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close, round(sum(value), 4) as total, count(*) as n from events group by 1, 2)
select start, event_type, open, high, low, close, total, n from b where start + interval 1 hour <= (select date_trunc('milliseconds', max(ts)) - interval 10 minute from events)""".replace("arg_min(value, (ts, event_id))", "first(value order by ts, event_id)").replace("arg_max(value, (ts, event_id))", "last(value order by ts, event_id)"))
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars; the last hour isn't closed yet."""
    return _run(spark, sf_dir, ev.bars).withColumn("total", F.round("total", 4))


@query("select event_type, count(*) as n, count(distinct event_id) as ids from events group by 1")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once, although the stream reads two copies of it."""
    twice = lambda events: ev.once(events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))).select("event_id", "event_type")
    return _run(spark, sf_dir, twice).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("select user_id, max(event_id) as event_id, arg_max(value, event_id) as value from events group by 1")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user, kept by upserts batch by batch; its id tells, not the batch it came in."""
    folder = shared_folder(spark, "stream")
    table = Table(spark, f"{folder}/table", ["user_id"])
    newest = lambda df: df.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))
    write = ev.upsert_versioned(table, F.desc("event_id"))
    stream = _events(spark, sf_dir).writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    stream.foreachBatch(lambda batch, number: write(newest(batch), number)).start().awaitTermination()
    return table.read()
