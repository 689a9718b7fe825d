"""Parquet tables with versions: a new version is written whole, then a pointer file is swapped."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import SharedFolder


class VersionedTable:
    """A table in ``root``, a folder on a file system that driver and executors share.

    Readers follow the pointer, so they see the old version or the new one whole. A
    write that dies leaves files nobody points to.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self._folder = SharedFolder(spark, root)

    def _pointer(self) -> dict | None:
        text = self._folder.read("current.json")
        return None if text is None else json.loads(text)

    @property
    def version(self) -> int:
        return (self._pointer() or {"version": 0})["version"]

    def read(self) -> DataFrame:
        now = self._pointer()
        if now is None:
            raise FileNotFoundError(f"{self.root} has no version yet")
        return self.spark.read.parquet(now["path"])

    def write(self, rows: DataFrame, tag: str | None = None, partition_by: tuple[str, ...] = ()) -> int:
        """The number of the new version; a ``tag`` that made the present version already is not written again."""
        now = self._pointer() or {"version": 0, "tag": None}
        if tag is not None and now["tag"] == tag:
            return now["version"]
        number = now["version"] + 1
        path = f"{self.root}/v{number:08d}-{uuid.uuid4().hex}"
        rows.write.partitionBy(*partition_by).parquet(path) if partition_by else rows.write.parquet(path)
        self._folder.replace("current.json", json.dumps({"version": number, "path": path, "tag": tag}))
        return number


class BucketedTable:
    """A table whose rows lie in buckets by the hash of a key; an update rewrites only the buckets it touches.

    The pointer names the folder of each bucket. Readers follow it, so that they see the
    old version or the new one whole; folders that no pointer names any more may be removed.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 256) -> None:
        self.spark, self.root, self.key, self.buckets = spark, root, key, buckets
        self._folder = SharedFolder(spark, root)

    def _pointer(self) -> dict | None:
        text = self._folder.read("current.json")
        return None if text is None else json.loads(text)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    @property
    def version(self) -> int:
        return (self._pointer() or {"version": 0})["version"]

    def _read(self, now: dict, buckets: list[int]) -> DataFrame:
        paths = [now["buckets"][str(b)] for b in buckets if str(b) in now["buckets"]]
        schema = StructType.fromJson(now["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        now = self._pointer()
        if now is None:
            raise FileNotFoundError(f"{self.root} has no version yet")
        return self._read(now, sorted(map(int, now["buckets"])))

    def write(self, rows: DataFrame) -> int:
        """A first or entirely new version; the number of it."""
        now = self._pointer() or {"version": 0}
        return self._put(rows, {"version": now["version"] + 1, "tag": None, "schema": rows.schema.jsonValue(), "buckets": {}})

    def update(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], tag: str | None = None) -> int:
        """The version after ``merge(rows, changes)`` on the buckets of the keys of ``changes``; a ``tag`` that made the present version is not applied again."""
        now = self._pointer()
        if tag is not None and now["tag"] == tag:
            return now["version"]
        touched = sorted(r[0] for r in changes.where(F.col(self.key).isNotNull()).select(self._bucket()).distinct().collect())  # at most one row per bucket
        if not touched:
            return now["version"]
        return self._put(merge(self._read(now, touched), changes), now | {"version": now["version"] + 1, "tag": tag})

    def _put(self, rows: DataFrame, pointer: dict) -> int:
        path = f"{self.root}/v{pointer['version']:08d}-{uuid.uuid4().hex}"
        columns = StructType.fromJson(pointer["schema"]).fieldNames()
        rows.select(*columns, self._bucket().alias("_bucket")).repartition("_bucket").write.partitionBy("_bucket").parquet(path)
        made = {n: f"{path}/_bucket={n}" for n in (f.removeprefix("_bucket=") for f in SharedFolder(self.spark, path).folders()) if n.isdigit()}
        self._folder.replace("current.json", json.dumps(pointer | {"buckets": pointer["buckets"] | made}))
        return pointer["version"]
