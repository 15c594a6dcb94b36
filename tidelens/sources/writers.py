"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelens.operators import panel
from tidelens.sources.shared import file_system


def parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("compression", "snappy")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def json_lines(df: DataFrame, path: str, append: bool = True) -> None:
    """One object a line, NULL fields written; NaN and infinities as NULL."""
    panel.normalise(df).write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def csv(df: DataFrame, path: str) -> None:
    flat = df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f.name) for f in df.schema.fields])
    flat.write.mode("overwrite").csv(path, header=True)


def upsert_parquet(new: DataFrame, path: str, target: str, key: list[str], new_wins: bool = True) -> None:
    """Rows of `path` (if it is there) and new rows, one a key, written to `target`: a table never overwrites what it reads."""
    spark = new.sparkSession
    exists = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path))
    merged = panel.upsert(spark.read.parquet(path), new, key, new_wins) if exists else new
    merged.write.mode("overwrite").parquet(target)


def next_start(df: DataFrame, entity: str = "ticker", date: str = "date") -> DataFrame:
    """entity and the day after its last row."""
    return df.groupBy(entity).agg(F.date_add(F.max(date), 1).alias("start"))


def missing_months(df: DataFrame, done: DataFrame, month: str = "month") -> DataFrame:
    """The rows of months that `done` doesn't have yet, so that a job goes on where it stopped."""
    return df.join(done.select(month).distinct(), month, "left_anti")


def json_report(df: DataFrame, path: str) -> None:
    """One object a line; NaN and infinities at any depth as NULL, and NULL fields written."""
    panel.finite(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


#: Bytes of lines that one merged file should hold.
FILE_BYTES = 256 << 20


def sharded_json_lines(df: DataFrame, path: str, shards: int, merged: str | None = None, keep: bool = True) -> None:
    """A file for each of `shards` workers below `path`; if asked for, all lines below `merged`, in one file or as many as FILE_BYTES asks for, and the shards are deleted unless kept."""
    spark = df.sparkSession
    panel.finite(df).repartition(shards).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    if merged:
        files, target = file_system(spark, path)
        size = files.getContentSummary(target).getLength()
        spark.read.text(path).repartition(max(1, -(-size // FILE_BYTES))).write.mode("overwrite").text(merged)
        if not keep:
            files.delete(target, True)
