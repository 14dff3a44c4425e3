"""Unpivot, pivot, sides, matching cascades and precedence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unpivot_pairs(df: DataFrame, ids: Sequence[str], metrics: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(metric, numerator, denominator) rows from one pass over ``df``; rows without numerator are left out."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), n.cast("double").alias("numerator"), d.cast("double").alias("denominator")) for m, (n, d) in metrics.items()])
    return df.select(*ids, F.explode(pairs).alias("p")).select(*ids, "p.*").filter("numerator IS NOT NULL")


def pivot_max(df: DataFrame, ids: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Entity-attribute-value rows to columns, by conditional maxima."""
    return df.groupBy(*ids).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n.lower()) for n in names])


def sides(df: DataFrame, shared: Sequence[str], home: dict[str, str], away: dict[str, str]) -> DataFrame:
    """One row for each side of a pairing; ``home`` and ``away`` map output columns to input columns."""
    both = F.array(*[F.struct(*[F.col(c).alias(o) for o, c in side.items()], F.lit(k).alias("is_home")) for k, side in ((True, home), (False, away))])
    return df.select(*shared, F.explode(both).alias("s")).select(*shared, "s.*")


def match_cascade(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """(left_id, right_id, matched_by): for each key in turn, rows that own the key's value alone on both sides are
    matched, and leave before the next key is tried. Null keys match nothing."""
    rest_l, rest_r, found = left, right, []
    for name, lk, rk in keys:
        alone = lambda df, i, k: df.select(F.col(i).alias(i), k.alias("_k")).filter("_k IS NOT NULL").groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.first(i).alias(i)).filter("_n = 1").drop("_n")
        hits = alone(rest_l, left_id, lk).join(alone(rest_r, right_id, rk), "_k").select(left_id, right_id, F.lit(name).alias("matched_by"))
        found.append(hits)
        rest_l, rest_r = rest_l.join(hits.select(left_id), left_id, "left_anti"), rest_r.join(hits.select(right_id), right_id, "left_anti")
    return reduce(DataFrame.unionByName, found)


def blank_shared_ids(df: DataFrame, id_columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """An id that several rows claim stays with the first by ``order``; the others get null. Rows without the id are not sorted."""
    for c in id_columns:
        place = F.row_number().over(Window.partitionBy(c).orderBy(*order))
        df = df.filter(F.col(c).isNotNull()).withColumn(c, F.when(place == 1, F.col(c))).unionByName(df.filter(F.col(c).isNull()))
    return df


def oriented(left: DataFrame, right: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Left pairs (a, b) with the value that ``right`` has for the pair in either direction; its sign turns with it."""
    keyed = right.groupBy(F.least(a, b).alias("_lo"), F.greatest(a, b).alias("_hi")).agg(F.sum(F.when(F.col(a) <= F.col(b), F.col(value)).otherwise(-F.col(value))).alias("_v"))
    rows = left.withColumn("_lo", F.least(a, b)).withColumn("_hi", F.greatest(a, b)).join(keyed, ["_lo", "_hi"], "left")
    return rows.withColumn(value, F.when(F.col(a) <= F.col(b), F.col("_v")).otherwise(-F.col("_v"))).drop("_lo", "_hi", "_v")


def tolerant(df: DataFrame, name: str, kind: str) -> Column:
    """The column cast to ``kind``: null where it cannot be, or where the column is absent."""
    return F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)


def rename_guarded(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename only where the new name is free."""
    for old, new in names.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df
