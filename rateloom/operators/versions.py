"""Models that are refitted as time goes by: coefficients in versions by cutoff, each from what stands strictly before it.

A version needs sums of cross products only. They are made for each period, added up over the periods before, and solved
where a refit is due; rows then read the last version whose cutoff is not after their own period. No row meets more than one
version, and no fit reads a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sums of a fit on two predictors x1 and x2 of y.
SUMS = {"n": "1", "s1": "x1", "s2": "x2", "sy": "y", "s11": "x1 * x1", "s22": "x2 * x2", "s12": "x1 * x2", "s1y": "x1 * y", "s2y": "x2 * y", "syy": "y * y"}


def prefix_sums(rows: DataFrame, key: Sequence[str], at: str, products: dict[str, str]) -> DataFrame:
    """(key, at, sums): for every period of a key the sums over all periods strictly before; null in the first."""
    cells = rows.groupBy(*key, at).agg(*[F.sum(F.expr(e).cast("double")).alias(c) for c, e in products.items()])
    before = Window.partitionBy(*key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)  # a row for each period
    return cells.select(*key, at, *[F.sum(c).over(before).alias(c) for c in products])


def versions(rows: DataFrame, key: Sequence[str], at: str, every: int, least: int) -> DataFrame:
    """(key, cutoff, n, b1, b2, intercept, mean): least squares of y on x1 and x2 over all rows before the cutoff, refitted at the
    first period and then at every ``every``-th; none where fewer than ``least`` rows stand before or the predictors are alike."""
    sums = prefix_sums(rows, key, at, SUMS)
    place = F.row_number().over(Window.partitionBy(*key).orderBy(at)) - 1
    sums = sums.withColumn("place", place).filter((F.col("place") % every == 0) & (F.col("n") >= least))
    centred = {"c11": "s11 - s1 * s1 / n", "c22": "s22 - s2 * s2 / n", "c12": "s12 - s1 * s2 / n", "c1y": "s1y - s1 * sy / n", "c2y": "s2y - s2 * sy / n"}
    fit = sums.selectExpr(*key, f"{at} AS cutoff", "n", "s1", "s2", "sy", *[f"{e} AS {c}" for c, e in centred.items()]).withColumn("det", F.expr("c11 * c22 - c12 * c12"))
    fit = fit.filter("det > 1e-9 * c11 * c22").withColumns({"b1": F.expr("(c1y * c22 - c2y * c12) / det"), "b2": F.expr("(c2y * c11 - c1y * c12) / det")})
    return fit.select(*key, "cutoff", F.col("n").cast("long").alias("n"), "b1", "b2", F.expr("(sy - b1 * s1 - b2 * s2) / n").alias("intercept"), F.expr("sy / n").alias("mean"))


def as_of(rows: DataFrame, table: DataFrame, key: Sequence[str], at: str, cutoff: str) -> DataFrame:
    """``rows`` with the columns of the last row of ``table`` whose cutoff is not after their ``at``; rows before the first are left out.

    The periods that rows have and the cutoffs are stacked, the last cutoff is carried forward over that small table, and rows
    join on their period alone.
    """
    values = [c for c in table.columns if c not in (*key, cutoff)]
    packed = table.select(*key, F.col(cutoff).alias(at), F.struct(F.col(cutoff).alias(cutoff), *values).alias("_version"))
    stacked = rows.select(*key, at).distinct().join(packed, [*key, at], "full")
    carried = Window.partitionBy(*key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    calendar = stacked.withColumn("_version", F.last("_version", True).over(carried)).filter("_version IS NOT NULL")
    return rows.join(calendar, [*key, at]).select(*rows.columns, "_version.*")
