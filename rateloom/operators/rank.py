"""Scores within groups: z-score, average-rank percentile, dense rank, boards, heads and tails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import save


def z_score(value: str, group: Sequence[str]) -> Column:
    """(x - mean) / sample deviation; 0 where that is undefined."""
    w = Window.partitionBy(*group)
    return F.coalesce((F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_samp(value).over(w), F.lit(0.0)), F.lit(0.0))


def average_percentile(value: str, group: Sequence[str]) -> Column:
    """Average rank over the count; unlike percent_rank, ties share their mean rank and the top is 1."""
    w = Window.partitionBy(*group)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, value))
    return (F.rank().over(w.orderBy(value)) + (ties - 1) / 2.0) / F.count(F.lit(1)).over(w)


def dense_rank_desc(value: str, group: Sequence[str]) -> Column:
    return F.dense_rank().over(Window.partitionBy(*group).orderBy(F.desc(value))).cast("long")


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "place") -> DataFrame:
    """The first ``k`` rows of each group with their place from 1; the group limit is applied before the exchange."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).filter(F.col(name) <= k)


def head_tail(df: DataFrame, group: Sequence[str], value: str, tie: str, k: int) -> DataFrame:
    """The ``k`` lowest and ``k`` highest rows of each group."""
    spec = Window.partitionBy(*group)
    df = df.withColumn("_low", F.row_number().over(spec.orderBy(F.asc(value), F.asc(tie)))).withColumn("_high", F.row_number().over(spec.orderBy(F.desc(value), F.asc(tie))))
    end = F.when(F.col("_low") <= k, F.lit("low")).when(F.col("_high") <= k, F.lit("high"))
    return df.withColumn("end", end).filter("end IS NOT NULL").drop("_low", "_high")


def shrink_multiplier(n: Column, raw: Column, league: Column, k: float) -> Column:
    """(n raw + k league) / (n + k) / league; 1 where there is nothing to go by."""
    value = (n * raw + k * league) / (n + k) / F.nullif(league, F.lit(0.0))
    return F.when((league > 0) & (n > 0), value).otherwise(F.lit(1.0))


def shrink_to_median(n: Column, own: Column, median: Column, half: float = 2.0) -> Column:
    w = n / (n + half)
    return w * own + (1 - w) * median


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "_k", size: str = "_n") -> DataFrame:
    """Row number from 0 of each group under ascending ``order``, and the group's size, with no group in one task.

    Rows are range-partitioned by (group, order) and counted by range; inside a range they are numbered by a sort, and the
    counts of the ranges before, a row for each range and group, are added.
    """
    rows = save(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = rows.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    own = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_rows").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"), before.alias("_before"), F.sum("_rows").over(own).alias(size))
    inside = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)) - 1
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    rows = rows.withColumn("_inside", inside).join(counts, same)
    return rows.withColumn(name, F.col("_inside") + F.col("_before")).drop("_inside", "_before", "_part", "_p", *[f"_g_{g}" for g in group])


def upper_median(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, value): element n // 2 of each group's sorted values, no interpolation; null values are left out."""
    rows = numbered(df.filter(F.col(value).isNotNull()).select(*group, value), group, [value])
    return rows.filter("_k = _n div 2").select(*group, value)


def match_marginal(df: DataFrame, group: Sequence[str], value: str, tie: str, target: DataFrame, target_value: str, name: str) -> DataFrame:
    """Give the rows of each group the marginal distribution of ``target`` while keeping their order.

    The row with rank r of n takes the target's value number floor(r m / n) of m. Both sides are numbered over ranges, and
    meet on (group, number), so no group is sorted in one task and no list of it is built.
    """
    there = numbered(target.select(*group, F.col(target_value).alias(name)), group, [name], "_k", "_m")
    sizes = there.groupBy(*group).agg(F.max("_m").alias("_size"))
    rows = numbered(df, group, [value, tie], "_r", "_n").join(sizes, list(group))
    rows = rows.withColumn("_k", F.floor(F.col("_r") * F.col("_size") / F.col("_n")).cast("long"))
    return rows.join(there.drop("_m"), [*group, "_k"]).drop("_r", "_n", "_size", "_k")
