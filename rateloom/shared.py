"""Helpers that every part of the library uses: scratch tables, worker imports, skew-safe group totals."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary
    one, removed when the process ends; on a cluster executors would not share it, which is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            folder = tempfile.mkdtemp(prefix="rateloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _LOCAL[app] = "file://" + folder
        base = _LOCAL[app]
    return f"{base.rstrip('/')}/rateloom-{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove the session's intermediate tables, once no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared scratch folder and read it back: the lineage ends in replicated files."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package, whatever folder the driver was started in. Batches that go
    to workers are held to 16 MB, unless the session sets a size of its own: texts differ much in length."""
    if spark.conf.get(BATCH_BYTES, None) == "67108864b":  # Spark's own setting
        spark.conf.set(BATCH_BYTES, str(16 << 20))
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attach_totals(rows: DataFrame, key: Sequence[str], salt_on: Column, partial: dict[str, Column], final: dict[str, Column], salts: int = 64) -> DataFrame:
    """Give every row the totals of its key, without bringing the rows of one key together.

    ``partial`` aggregates each (key, salt); ``final`` aggregates those results for each key. The totals return to the
    rows over (key, salt), so that a key with a third of all rows is spread over up to ``salts`` tasks. Keys compare
    as equal when both are null.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)).cast("int"))
    per_salt = salted.groupBy(*key, "_salt").agg(*[c.alias(n) for n, c in partial.items()])
    totals = per_salt.groupBy(*key).agg(*[c.alias(n) for n, c in final.items()], F.collect_set("_salt").alias("_salts"))
    spread = totals.select(*[F.col(k).alias(f"_k_{k}") for k in key], *final, F.explode("_salts").alias("_k_salt"))
    same = F.col("_salt") == F.col("_k_salt")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return salted.join(spread, same).drop("_salt", "_k_salt", *[f"_k_{k}" for k in key])


def attach(rows: DataFrame, values: DataFrame, key: str, salt_on: Column, salts: int = 64) -> DataFrame:
    """Left join of ``values`` (one row per key) to ``rows``; both have the column ``key``.

    A key's row of ``values`` is repeated for each salt that its rows have, at most ``salts`` times, so the rows of one
    frequent key need not meet in one task. ``rows`` is read twice: pass a saved or cheap table.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)).cast("int"))
    spread = salted.select(key, "_salt").distinct().join(values, key)
    return salted.join(spread, [key, "_salt"], "left").drop("_salt")
