"""Sinks over plain Parquet: slices, upserts, appends, guarded replacement and published snapshots.

A table is a folder of versions with a pointer file; a write makes a new version beside the one that readers use and then
moves the pointer, so nobody reads half a table and nothing is overwritten while it is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Table:
    """A versioned Parquet table below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _pointer(self) -> str:
        return f"{self.path}/CURRENT"

    def current(self) -> str | None:
        """Folder of the published version."""
        fs, p = _fs(self.spark, self._pointer())
        if not fs.exists(p):
            return None
        return f"{self.path}/{self.spark.read.text(self._pointer()).first()[0]}"

    def read(self) -> DataFrame | None:
        now = self.current()
        return self.spark.read.parquet(now) if now else None

    def replace(self, df: DataFrame, allow_empty: bool = False, partition_by: Sequence[str] = ()) -> bool:
        """Write a new version and publish it. An empty frame does not replace a table unless that is allowed."""
        if not allow_empty and df.isEmpty():
            return False
        version = f"v-{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/{version}")
        fs, pointer = _fs(self.spark, self._pointer())
        _, draft = _fs(self.spark, f"{self.path}/.{version}")
        out = fs.create(draft, True)
        out.write(bytearray(version.encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(draft, pointer, rename)
        return True

    def append(self, df: DataFrame) -> None:
        old = self.read()
        self.replace(df if old is None else old.unionByName(df, allowMissingColumns=True), allow_empty=True)

    def upsert(self, df: DataFrame, key: Sequence[str]) -> None:
        """Rows of ``df`` take the place of those with their key."""
        old = self.read()
        self.replace(df if old is None else old.join(df.select(*key), list(key), "left_anti").unionByName(df, allowMissingColumns=True), allow_empty=True)

    def insert_ignore(self, df: DataFrame, key: Sequence[str]) -> None:
        """Rows whose key is there already are left out."""
        old = self.read()
        self.replace(df if old is None else old.unionByName(df.join(old.select(*key), list(key), "left_anti"), allowMissingColumns=True), allow_empty=True)

    def replace_where(self, df: DataFrame, predicate: str) -> None:
        """Rows that meet ``predicate`` go, the rows of ``df`` come; rows for which it is null stay."""
        old = self.read()
        self.replace(df if old is None else old.filter(~F.coalesce(F.expr(predicate), F.lit(False))).unionByName(df, allowMissingColumns=True), allow_empty=True)

    def vacuum(self) -> int:
        """Remove versions that are not the published one; returns how many."""
        now, n = self.current(), 0
        fs, root = _fs(self.spark, self.path)
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            if name.startswith("v-") and f"{self.path}/{name}" != now:
                fs.delete(s.getPath(), True)
                n += 1
        return n


def overwrite_slices(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace just the partitions that occur in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def archive_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("append").option("compression", "gzip").text(path)
