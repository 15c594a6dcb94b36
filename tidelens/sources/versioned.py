"""A keyed table in versions: an upsert rewrites only the buckets that its rows fall into, and a new version shows all at once or not at all.

Rows lie in buckets by a hash of their key. A version is a manifest, a small JSON file that names the folder of each bucket; the greatest number is the
table. An upsert reads the touched buckets of the last version, writes them anew beside the old ones, and then puts a new manifest in place by a rename.
Until then readers see the old version, also if the job dies in between. Folders that no kept version names are deleted afterwards.

The number of buckets is fixed when the table is made. A batch that carries a number not above the last one's was written before, and changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelens.operators import panel
from tidelens.sources.shared import file_system

BUCKETS = 64
#: Versions that stay readable.
KEPT = 2


class Table:
    """The table below a folder that the driver and all executors see."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], buckets: int = BUCKETS, kept: int = KEPT):
        self.spark, self.root, self.key, self.buckets, self.kept = spark, root, key, buckets, kept
        self.files, self.path = file_system(spark, root)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        at = self._path("versions")
        names = [f.getPath().getName() for f in self.files.listStatus(at)] if self.files.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int) -> dict:
        stream = self.files.open(self._path(f"versions/{version:09}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def last(self) -> dict | None:
        found = self.versions()
        return self.manifest(found[-1]) if found else None

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of a version (the last one), or of some of its buckets; None if there is no table yet."""
        own = self.last() if version is None else self.manifest(version)
        if own is None:
            return None
        schema = T.StructType.fromJson(own["schema"])
        paths = [f"{self.root}/{p}" for b, p in own["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def upsert(self, new: DataFrame, order: Column | None = None, batch: int | None = None) -> int:
        """The number of the version with new's rows: of a key's old and new rows the first by `order` stays, or the new one."""
        old = self.last()
        if old is not None:
            self.buckets = old["buckets"]
            if batch is not None and old["batch"] is not None and batch <= old["batch"]:
                return old["version"]
        placed = new.withColumn("_bucket", self._bucket())
        touched = sorted(r[0] for r in placed.select("_bucket").distinct().collect())  # BUCKETS rows at most
        before = self.read(buckets=touched) if old is not None else None
        if before is None:
            merged = panel.keep_newest(new, self.key, order) if order is not None else new.dropDuplicates(self.key)
        elif order is not None:
            merged = panel.keep_newest(before.unionByName(new, allowMissingColumns=True), self.key, order)
        else:
            merged = panel.upsert(before, new.dropDuplicates(self.key), self.key)
        folder = f"data/{uuid.uuid4().hex}"
        if touched:
            # One task a bucket: its rows are few against the table's.
            merged.withColumn("_bucket", self._bucket()).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        folders = (old["folders"] if old else {}) | {str(b): f"{folder}/_bucket={b}" for b in touched}
        version = old["version"] + 1 if old else 0
        self._swap({"version": version, "batch": batch, "buckets": self.buckets, "schema": merged.schema.jsonValue(), "folders": folders})
        self._clean()
        return version

    def _swap(self, manifest: dict) -> None:
        """Show a version: its manifest is written aside and renamed, which takes place wholly or not at all."""
        final, aside = self._path(f"versions/{manifest['version']:09}.json"), self._path(f"versions/.{uuid.uuid4().hex}")
        stream = self.files.create(aside, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if self.files.exists(final) or not self.files.rename(aside, final):
            self.files.delete(aside, False)
            raise RuntimeError(f"version {manifest['version']} of {self.root} was written by another job")

    def _clean(self) -> None:
        """Delete versions beyond the kept ones, and folders that none of these names."""
        found = self.versions()
        used = {p for v in found[-self.kept :] for p in self.manifest(v)["folders"].values()}
        for v in found[: -self.kept]:
            self.files.delete(self._path(f"versions/{v:09}.json"), False)
        for folder in self.files.listStatus(self._path("data")) if self.files.exists(self._path("data")) else []:
            name = f"data/{folder.getPath().getName()}"
            parts = [f"{name}/{p.getPath().getName()}" for p in self.files.listStatus(folder.getPath()) if p.isDirectory()]
            for part in parts if any(p in used for p in parts) else [name]:
                if part not in used:
                    self.files.delete(self._path(part), True)
