"""Folders that the driver and all executors see, for what a job writes and reads again."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

#: What this process has written below the shared folder and not deleted yet: path -> session.
_WRITTEN: dict[str, SparkSession] = {}
_LOCAL_ROOT: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Without one a local session gets a temporary folder; a cluster is an error."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="tidelens-"))
    return _LOCAL_ROOT[0]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, which is deleted when the process ends if not before."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def saved(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same rows as a Parquet table below the shared folder, read again; and its path."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as its own."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete(path: str) -> None:
    """Delete what shared_folder() has named."""
    spark = _WRITTEN.pop(path, None)
    if spark is not None:
        files, target = file_system(spark, path)
        files.delete(target, True)


@atexit.register
def _delete_rest() -> None:
    """What results may still be read from goes when the process ends; the JVM may be gone by then."""
    for path in list(_WRITTEN):
        with suppress(Exception):
            delete(path)
