"""Weighted moments, ratios, shares, marginals, correlations and scorecards as plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    """n / d, null where d is 0."""
    return n / F.nullif(d, F.lit(0.0))


def recency_weight(ago: Column, prior_season: Column, decay: float = 0.8, discount: float = 0.85) -> Column:
    return F.pow(F.lit(decay), ago) * F.when(prior_season, F.lit(discount)).otherwise(F.lit(1.0))


def weighted_moments(x: Column, w: Column) -> dict[str, Column]:
    """Weighted mean, reliability-corrected variance and Kish effective size, from four sums."""
    v1, v2, s1, s2 = F.sum(w), F.sum(w * w), F.sum(w * x), F.sum(w * x * x)
    mean = ratio(s1, v1)
    spare = v1 - ratio(v2, v1)
    variance = F.when(spare > 1e-12, F.greatest((s2 - s1 * s1 / F.nullif(v1, F.lit(0.0))) / F.nullif(spare, F.lit(0.0)), F.lit(0.0)))
    return {"w_mean": mean, "w_variance": variance, "ess": ratio(v1 * v1, v2), "w_total": v1}


def wls_origin(x: Column, y: Column, w: Column) -> dict[str, Column]:
    """Weighted fit through the origin: slope in [0, 1], and the prior games that it implies for a window of 8."""
    slope = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio(F.sum(w * x * y), F.sum(w * x * x))))
    return {"beta": slope, "implied_k": F.when(slope <= 1e-6, F.lit(1e6)).otherwise(8.0 * (1 - slope) / slope)}


def with_marginal(df: DataFrame, cell: Sequence[str], over: str, aggs: dict[str, Column], all_name: str = "ALL") -> DataFrame:
    """Aggregates by (cell, over), and for each cell over all values of ``over``: grouping sets in one pass."""
    rest = [c for c in cell if c != over]
    return df.groupingSets([[*rest, over], rest], *rest, over).agg(F.grouping(over).alias("_g"), *[c.alias(n) for n, c in aggs.items()]).withColumn(over, F.when(F.col("_g") == 1, F.lit(all_name)).otherwise(F.col(over))).drop("_g")


def share_of_total(df: DataFrame, entity: Sequence[str], group: Sequence[str], value: str) -> DataFrame:
    """Entity totals and their share of the group's; the group's total is a second small aggregate of the first."""
    own = df.groupBy(*group, *entity).agg(F.sum(value).alias("total"))
    whole = own.groupBy(*group).agg(F.sum("total").alias("group_total"))
    return own.join(whole, list(group)).withColumn("share", ratio(F.col("total"), F.col("group_total")))


def pair_correlation(df: DataFrame, at: str, name: str, value: str, least: float) -> DataFrame:
    """Pearson correlation of every two series with names a < b over common times, where it exceeds ``least``.

    Pairs are made within a time only, where each series has one row.
    """
    a, b = (df.select(at, F.col(name).alias(n), F.col(value).cast("double").alias(f"v{n}")) for n in "ab")
    rows = a.join(b, at).filter("a < b").groupBy("a", "b").agg(F.corr("va", "vb").alias("r"), F.count(F.lit(1)).alias("n"))
    return rows.filter(F.abs("r") >= least)


def joint_vs_independent(df: DataFrame, legs: Sequence[str]) -> dict[str, Column]:
    """Probability that all legs hold in a draw, the product of their own, and the ratio."""
    every = F.avg(F.when(F.least(*[F.col(c).cast("int") for c in legs]) == 1, 1.0).otherwise(0.0))
    alone = [F.avg(F.col(c).cast("double")) for c in legs]
    product = alone[0]
    for c in alone[1:]:
        product = product * c
    return {"joint": every, "independent": product, "lift": ratio(every, product)}


def scorecard() -> dict[str, Column]:
    """Calibration figures from projected_median, projected_p25, projected_p75, p_over_median, pit and actual."""
    inside = F.when(F.col("actual").between(F.col("projected_p25"), F.col("projected_p75")), 1.0).otherwise(0.0)
    over = F.when(F.col("actual") > F.col("projected_median"), 1.0).otherwise(0.0)
    error = F.col("projected_median") - F.col("actual")
    return {
        "n": F.count(F.lit(1)), "mae": F.avg(F.abs(error)), "bias": F.avg(error), "coverage": F.avg(inside),
        "brier": F.avg(F.pow(F.col("p_over_median") - over, F.lit(2))), "median_projected": F.median("projected_median"), "median_actual": F.median("actual"),
        "over_rate": F.avg(over), "degenerate_rate": F.avg(F.when(F.col("projected_p25") == F.col("projected_p75"), 1.0).otherwise(0.0)), "pit_mean": F.avg("pit"),
    }


def fill_rates(df: DataFrame, columns: Sequence[str], active: Column) -> DataFrame:
    """(field, filled, filled_active, rate, rate_active) for each column, from one aggregate row."""
    n, m = F.count(F.lit(1)), F.count(F.when(active, 1))
    one = df.agg(n.alias("n"), m.alias("m"), *[F.count(c).alias(f"a_{c}") for c in columns], *[F.count(F.when(active, F.col(c))).alias(f"b_{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").alias("filled"), F.col(f"b_{c}").alias("filled_active")) for c in columns])
    return one.select("n", "m", F.explode(rows).alias("r")).select("r.*", ratio(F.col("r.filled").cast("double"), F.col("n").cast("double")).alias("rate"), ratio(F.col("r.filled_active").cast("double"), F.col("m").cast("double")).alias("rate_active"))
