"""Structured Streaming over event files: bars, late rows and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.operators import panel
from tidelens.sources.versioned import Table

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, schema: str = EVENTS, fmt: str = "parquet", files_at_once: int | None = 8) -> DataFrame:
    """The rows of the files, so many files a batch; None: all there are in one batch, so that none is late whatever the files' order."""
    stream = spark.readStream.format(fmt).schema(schema)
    return (stream.option("maxFilesPerTrigger", files_at_once) if files_at_once else stream).load(path)


def bars(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """Open, high, low, close, sum and number of values of each key and window, once no row may come any more."""
    first = F.struct("ts", "event_id", "value")
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), key)
        .agg(F.min(first)["value"].alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max(first)["value"].alias("close"), F.sum("value").alias("total"), F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), key, "open", "high", "low", "close", "total", "n")
    )


def once(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def upsert_to(folder: str, key: list[str], order: Column | None = None):
    """A foreachBatch sink: every batch makes a new version of the table below `folder` from the last one. A batch that is run again makes the same version.

    Of a key's old and new rows the first by `order` stays, whatever batch it came in; without an order, the newer batch's.
    """

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return panel.upsert(old, new, key) if order is None else panel.keep_newest(old.unionByName(new, allowMissingColumns=True), key, order)

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        merged = merge(spark.read.parquet(f"{folder}/v{number - 1}"), batch) if number else batch
        merged.write.mode("overwrite").parquet(f"{folder}/v{number}")

    return run


def upsert_versioned(table: Table, order: Column | None = None):
    """A foreachBatch sink: every batch rewrites the buckets of a versioned table that its keys fall into. A batch that is run again changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        table.upsert(batch, order, number)

    return run
