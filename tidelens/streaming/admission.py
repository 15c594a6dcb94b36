"""A backlog of files as a stream in order of time, whatever order the files have.

A streaming source takes files as they come; where these are in no order of time, later batches' rows come behind the watermark and are lost. So the least and the greatest
time of every file are asked first, and files are admitted in groups: between two groups nothing is left that the watermark after the first could leave out.
Each group is a run of the same query on the same checkpoint, so the state holds what is open between two groups, not the whole backlog.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime, timedelta
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

Span = tuple[str, datetime, datetime]


def file_spans(spark: SparkSession, path: str, schema: str, time: str = "ts", fmt: str = "parquet") -> list[Span]:
    """Each file's path, least and greatest time: one row a file. Of Parquet files only the column of times is read. Files without a time come at any place."""
    rows = spark.read.format(fmt).schema(schema).load(path).select(F.col("_metadata.file_path").alias("file"), time)
    found = rows.groupBy("file").agg(F.min(time).alias("a"), F.max(time).alias("b")).collect()
    first = min((r.a for r in found if r.a), default=datetime(1970, 1, 1))
    return [(unquote(r.file), r.a or first, r.b or first) for r in found]


def in_order(spans: Iterable[Span], late: timedelta, least: int = 8) -> list[list[str]]:
    """Groups of files in order of time, of `least` files or more: no row of a group is more than `late` behind the greatest time of the groups before it."""
    groups: list[list[str]] = []
    reach: datetime | None = None
    for name, first, last in sorted(spans, key=lambda s: (s[1], s[2], s[0])):
        # All later files begin here or after, so a cut before this file is safe for all of them.
        if not groups or (len(groups[-1]) >= least and first >= reach - late):
            groups.append([])
        groups[-1].append(name)
        reach = last if reach is None else max(reach, last)
    return groups


def run_in_order(spark: SparkSession, groups: list[list[str]], schema: str, start: Callable[[DataFrame], DataStreamWriter], fmt: str = "parquet") -> None:
    """Run the query that `start` makes of a stream over one group of files after another, to the end of each. `start` names the checkpoint that they share."""
    for own in groups:
        folder = own[0].rsplit("/", 1)[0]
        if any(not f.startswith(f"{folder}/") for f in own):
            folder = _common(own)
        names = ",".join(f.removeprefix(f"{folder}/").replace(",", "\\,") for f in own)
        stream = spark.readStream.format(fmt).schema(schema).load(f"{folder}/{{{names}}}")  # a pattern, also of one file: a source takes folders and patterns
        start(stream).trigger(availableNow=True).start().awaitTermination()


def _common(files: list[str]) -> str:
    """The deepest folder that all files lie below."""
    parts = [f.split("/")[:-1] for f in files]
    n = next((i for i in range(min(map(len, parts))) if len({p[i] for p in parts}) > 1), min(map(len, parts)))
    return "/".join(parts[0][:n])
