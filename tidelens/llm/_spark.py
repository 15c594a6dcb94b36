"""Spark helpers that the operators share."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelens.llm._text import chunks
from tidelens.sources import shared
from tidelens.sources.shared import _WRITTEN, delete, shared_folder, shared_root

#: Bytes of text that one reducing task should get at most.
TASK_BYTES = 12 << 20
#: Beyond so many tasks of that size tasks grow instead, up to MOST_BYTES: rows stream through them.
MANY_TASKS, MOST_BYTES = 20_000, 512 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stable(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared checkpoint folder, so that a lost executor loses nothing."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(spark))
    out = df.checkpoint()
    if path := _files(out):
        _WRITTEN[path] = spark
    return out


def _files(kept: DataFrame) -> str | None:
    """Where the rows of a stable() frame lie."""
    plan = kept._jdf.queryExecution().logical()
    found = plan.rdd().getCheckpointFile()
    return found.get() if found.isDefined() else None


def forget(*kept: DataFrame) -> None:
    """Delete the files of stable() frames that nothing reads any more."""
    for df in kept:
        if path := _files(df):
            delete(path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as a Parquet table below the shared folder and read again."""
    return shared.saved(df, name)[0]


#: A key of more than this share of all rows is joined by broadcast; there are at most 1 / HOT_SHARE of these.
HOT_SHARE = 0.001


def join_hot(rows: DataFrame, known: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the columns of `known`, which has one row a key and `n`, how many of the `total` rows have that key.

    The rows of frequent keys, whose number HOT_SHARE bounds, never meet in one task: their keys are broadcast. The others are shuffled.
    """
    hot = stable(known.filter(F.col("n") > F.lit(total * HOT_SHARE)))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    out = rest.join(known.filter(F.col("n") <= F.lit(total * HOT_SHARE)), key)
    return out.unionByName(rows.join(F.broadcast(hot), key)).drop("n")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def parts(amount: float, each: float, least: int = 1) -> int:
    """How many pieces of about `each` hold `amount`."""
    return max(least, math.ceil(amount / each))


def tasks(docs: DataFrame) -> int:
    """How many tasks share out the texts of docs: TASK_BYTES each up to MANY_TASKS, then larger ones up to MOST_BYTES."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = text_bytes(docs)
    return parts(total, min(max(TASK_BYTES, total / MANY_TASKS), MOST_BYTES), min(least, 16))


def with_found(docs: DataFrame, task, found: str, text: str = "text") -> tuple[DataFrame, list[str]]:
    """All columns of docs, as c0, c1 and so on, beside what task(chunk) finds for every row; and docs' names for them.

    The numbered names keep any column of docs apart from what is found. Nothing is shuffled.
    """
    names, n = docs.columns, len(docs.columns)
    plain = docs.toDF(*[f"c{i}" for i in range(n)])
    at = f"c{names.index(text)}"

    def run(batches):
        for chunk in chunks(batches, at):
            own, new = {c: chunk.column(c) for c in chunk.batch.schema.names}, task(chunk)
            yield pa.RecordBatch.from_pydict(own | {c: new[c] for c in order})

    added = T._parse_datatype_string(found).fields
    order = [f.name for f in added]
    schema = T.StructType([*plain.schema.fields, *added])
    return plain.mapInArrow(run, schema), names


def only(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns of docs from with_found(), under their own names."""
    return df.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)
