"""Replay with refits: environment models as they would have been fitted before each quarter, scored on what came next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versions
from ..shared import save, table
from . import projection
from .registry import big, query, rounded

EVERY, LEAST = 3, 500

ROWS = projection.FRAME + f""",
    stacked AS ({projection._STACK}),
    dated AS (SELECT stacked.*, (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS period, year(o_orderdate)::BIGINT AS season FROM stacked JOIN orders USING (o_orderkey)),
    cutoffs AS (SELECT target, period AS cutoff FROM (SELECT target, period, row_number() OVER (PARTITION BY target ORDER BY period) - 1 AS k FROM (SELECT DISTINCT target, period FROM dated)) WHERE k % {EVERY} = 0),
    sums AS (SELECT target, cutoff, count(*)::BIGINT AS n, avg(total) AS m1, avg(spread) AS m2, avg(y) AS my, var_pop(total) AS v1, var_pop(spread) AS v2, covar_pop(total, spread) AS c, covar_pop(total, y) AS c1, covar_pop(spread, y) AS c2
             FROM dated JOIN cutoffs USING (target) WHERE period < cutoff GROUP BY 1, 2 HAVING count(*) >= {LEAST}),
    slopes AS (SELECT *, (c1 * v2 - c2 * c) / (v1 * v2 - c * c) AS b1, (c2 * v1 - c1 * c) / (v1 * v2 - c * c) AS b2 FROM sums WHERE v1 * v2 - c * c > 1e-9 * v1 * v2),
    versions AS (SELECT target, cutoff, n, b1, b2, my - b1 * m1 - b2 * m2 AS intercept, my AS mean FROM slopes)"""


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, period, season, x1, x2, y, low, high): every target of every game with its predictors and bounds."""
    dates = table(spark, sf_dir, "orders").select("o_orderkey", big(F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("period"), big(F.year("o_orderdate")).alias("season"))
    rows = projection.training_frame(spark, sf_dir).join(dates, "o_orderkey")
    one = [F.struct(F.lit(t).alias("target"), F.col(t).alias("y"), F.lit(lo).alias("low"), F.lit(hi).alias("high")) for t, (lo, hi) in projection.TARGETS.items()]
    return rows.select("period", "season", F.col("total").alias("x1"), F.col("spread").alias("x2"), F.explode(F.array(*one)).alias("m")).select("period", "season", "x1", "x2", "m.*")


@query(f"WITH {ROWS} SELECT target, cutoff, n, round(b1, 6) AS by_total, round(b2, 6) AS by_spread, round(intercept, 5) AS intercept FROM versions")
def refit_versions(spark, sf_dir):
    """Coefficients of every environment model as of each quarter."""
    rows = versions.versions(save(dated(spark, sf_dir), "dated"), ["target"], "period", EVERY, LEAST)
    return rounded(rounded(rows.select("target", "cutoff", "n", F.col("b1").alias("by_total"), F.col("b2").alias("by_spread"), "intercept"), "by_total", "by_spread"), "intercept", digits=5)


@query(f"""WITH {ROWS},
    read AS (SELECT d.*, v.* EXCLUDE target FROM dated d ASOF JOIN versions v ON v.target = d.target AND v.cutoff <= d.period),
    scored AS (SELECT *, least(high, greatest(low, intercept + b1 * total + b2 * spread)) AS predicted FROM read)
    SELECT target, season, count(*)::BIGINT AS n, round(avg(period - cutoff), 6) AS age, round(avg(abs(y - predicted)), 5) AS mae, round(avg(predicted - y), 5) AS bias, round(100 * (1 - sum((y - predicted) ** 2) / nullif(sum((y - mean) ** 2), 0)), 4) AS gain
    FROM scored GROUP BY 1, 2""")
def refit_replay(spark, sf_dir):
    """Games predicted by the version that stood when they were played: error, bias, age of the version in months, and what it takes off the squared error of its own mean."""
    rows = save(dated(spark, sf_dir), "dated")
    read = versions.as_of(rows, save(versions.versions(rows, ["target"], "period", EVERY, LEAST), "versions"), ["target"], "period", "cutoff")
    predicted = F.least("high", F.greatest("low", F.col("intercept") + F.col("b1") * F.col("x1") + F.col("b2") * F.col("x2")))
    read = read.withColumn("error", predicted - F.col("y"))
    out = read.groupBy("target", "season").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("period") - F.col("cutoff")).alias("age"), F.avg(F.abs("error")).alias("mae"), F.avg("error").alias("bias"),
        (100 * (1 - F.sum(F.col("error") * F.col("error")) / F.nullif(F.sum(F.pow(F.col("y") - F.col("mean"), 2)), F.lit(0.0)))).alias("gain"))
    return rounded(rounded(rounded(out, "age"), "mae", "bias", digits=5), "gain", digits=4)
