"""Tables in numbered versions, and tables that grow by batches and are compacted.

Both keep whole Parquet folders beside each other and decide by names which of them
count, so a reader never sees half a write.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class VersionConflict(Exception):
    """Someone else wrote the version that was to be written."""


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _filesystem(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


# --- numbered versions ------------------------------------------------------------


def _marker(path: str, version: int) -> str:
    return f"{path}/_versions/{version:012d}"


def _folder_of(spark: SparkSession, path: str, version: int) -> str:
    fs, where = _filesystem(spark, _marker(path, version))
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def newest_version(spark: SparkSession, path: str) -> int:
    """The number of the newest complete version; 0 for a table without any."""
    numbers = sorted((int(n) for n in _names(spark, f"{path}/_versions") if n.isdigit()), reverse=True)
    # A marker is empty for the moment between its creation and its writing.
    return next((n for n in numbers if _folder_of(spark, path, n)), 0)


def read_version(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """The table as of a version, by default the newest."""
    number = newest_version(spark, path) if version is None else version
    if number == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{_folder_of(spark, path, number)}")


def write_version(df: DataFrame, path: str, base: int) -> int:
    """Write `df` as the version after `base`; its number.

    The rows go to a folder of their own first. The version exists from when its marker
    is created, which fails with VersionConflict if there is one: then another writer
    started from the same base, and its rows stay.
    """
    spark, number, folder = df.sparkSession, base + 1, f"rows-{uuid.uuid4().hex}"
    if newest_version(spark, path) != base:
        raise VersionConflict(f"version {base} of {path} is not the newest")
    df.write.parquet(f"{path}/{folder}")
    fs, where = _filesystem(spark, _marker(path, number))
    try:
        stream = fs.create(where, False)
    except Exception as e:
        if fs.exists(where):
            raise VersionConflict(f"version {number} of {path} was written by another") from e
        raise
    stream.write(folder.encode())
    stream.close()
    return number


# --- batches with snapshots ----------------------------------------------------------


class BatchTable:
    """Rows by batch number, of which every so many are merged into one snapshot.

    A batch is a folder, replaced whole if the batch is repeated. A snapshot holds the
    merged rows of all batches up to one; it counts once Spark has committed it. What a
    snapshot stands for is deleted when the next one is complete, so that readers of the
    former keep their files: there are never more than two snapshots and twice `every`
    batches.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        merge: Callable[[DataFrame], DataFrame] | None = None,
        every: int = 16,
        partition_by: tuple[str, ...] = (),
    ):
        self.spark, self.path, self.schema, self.every = spark, path, schema, every
        self.merge, self.partition_by = merge or (lambda df: df), list(partition_by)

    def _numbers(self, kind: str) -> list[int]:
        found = (re.fullmatch(rf"{kind}-(\d+)", n) for n in _names(self.spark, self.path))
        return sorted(int(m[1]) for m in found if m)

    def _complete(self, number: int) -> bool:
        fs, where = _filesystem(self.spark, f"{self.path}/upto-{number}/_SUCCESS")
        return fs.exists(where)

    def _snapshots(self, before: int | None = None) -> list[int]:
        found = [n for n in self._numbers("upto") if self._complete(n)]
        return [n for n in found if before is None or n < before]

    def exists(self) -> bool:
        return bool(self._numbers("batch") or self._snapshots())

    def folders(self, before: int | None = None) -> list[str]:
        """The folders that hold all batches, or all before one."""
        snapshot = max(self._snapshots(before), default=-1)
        batches = [n for n in self._numbers("batch") if n > snapshot and (before is None or n < before)]
        return [f"{self.path}/upto-{snapshot}"] * (snapshot >= 0) + [f"{self.path}/batch-{n}" for n in batches]

    def read(self, before: int | None = None) -> DataFrame:
        """All rows, not merged beyond the snapshot."""
        folders = self.folders(before)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        parts = [self.spark.read.schema(self.schema).parquet(f) for f in folders]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _write(self, df: DataFrame, name: str) -> None:
        writer = df.write.mode("overwrite")
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        writer.parquet(f"{self.path}/{name}")

    def write(self, df: DataFrame, number: int) -> None:
        """Write a batch; every so many also a snapshot."""
        self._write(df, f"batch-{number}")
        if number % self.every == self.every - 1:
            self.compact(number)

    def compact(self, number: int) -> None:
        """Merge all batches up to `number`, and drop what the snapshot before stands for."""
        former = max(self._snapshots(number), default=-1)
        batch = self.spark.read.schema(self.schema).parquet(f"{self.path}/batch-{number}")
        rows = self.merge(self.read(number).unionByName(batch))
        self._write(rows.repartition(*self.partition_by) if self.partition_by else rows, f"upto-{number}")
        for kind, last in (("batch", former), ("upto", former - 1)):
            for n in self._numbers(kind):
                if n <= last:
                    fs, where = _filesystem(self.spark, f"{self.path}/{kind}-{n}")
                    fs.delete(where, True)
