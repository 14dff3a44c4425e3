"""Scores and widths of count projections, and laws beyond the counts': empirical, gamma, beta, weighted sums.

A customer's orders of a year, and the urgent ones among them, are counts; the law of a year has the mean and variance of the
customer's years before it. A year with orders but none urgent counts as zero urgent ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import laws
from ..shared import save, table
from . import projection
from .registry import query, rounded

#: Variance scales that are tried; rows of a cell that chooses for itself; the mass that the middle should hold (fixed values).
GRID = tuple([k / 10 for k in range(5, 10)] + [1 + k / 8 for k in range(13)])
LEAST_ROWS, TARGET = 60, 0.5

COUNT_LAWS = projection.GAMES + """,
    years AS (SELECT entity, team, season, count(*)::DOUBLE AS orders, sum(urgent)::DOUBLE AS urgent FROM games GROUP BY 1, 2, 3),
    counted AS (SELECT entity, team, season, 'orders' AS stat, orders AS x FROM years UNION ALL SELECT entity, team, season, 'urgent', urgent FROM years),
    laws AS (SELECT *, v / m > 1.3 AS wide FROM (SELECT *, avg(x) OVER w AS m, var_samp(x) OVER w AS v, count(*) OVER w AS k FROM counted WINDOW w AS (PARTITION BY entity, stat ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE k >= 2 AND m > 0)"""


def mass_sql(x: str, spread: str, m: str = "m") -> str:
    """The law's probability of x, in closed form."""
    r = f"(1 / greatest(({spread} - {m}) / ({m} * {m}), 1e-9))"
    return f"CASE WHEN {spread} IS NULL THEN exp({x} * ln({m}) - {m} - lgamma({x} + 1)) ELSE exp(lgamma({x} + {r}) - lgamma({r}) - lgamma({x} + 1) + {r} * ln({r} / ({r} + {m})) + {x} * ln({m} / ({r} + {m}))) END"


def count_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, team, season, stat, x, m, v, wide): counts with mean and variance of the two or more years before; ``wide``: negative binomial."""
    years = projection.games(spark, sf_dir).groupBy("entity", "team", "season").agg(F.count(F.lit(1)).cast("double").alias("orders"), F.sum("urgent").cast("double").alias("urgent"))
    rows = years.unpivot(["entity", "team", "season"], ["orders", "urgent"], "stat", "x")
    before = Window.partitionBy("entity", "stat").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"m": F.avg("x").over(before), "v": F.var_samp("x").over(before), "k": F.count("x").over(before)}).filter("k >= 2 AND m > 0")
    return rows.withColumn("wide", F.col("v") / F.col("m") > 1.3).drop("k")


def scaled_variance(scale: Column) -> Column:
    """The variance of a row's law at a scale: at least 1.05 means if negative binomial; a Poisson law cannot be narrowed, and turns into one above 1.05 (null: it stays)."""
    m, v, more = F.col("m"), F.col("v"), F.greatest(scale, F.lit(1.0))
    return F.when(F.col("wide"), F.greatest(v * scale, 1.05 * m)).when(more > 1.05, m * more)


_SPREAD = "CASE WHEN wide THEN greatest(v * {0}, 1.05 * m) WHEN greatest({0}, 1.0) > 1.05 THEN m * greatest({0}, 1.0) END"


@query(f"""WITH {COUNT_LAWS},
    terms AS (SELECT *, {mass_sql("j", "spread")} AS p FROM (SELECT *, {_SPREAD.format("1.0")} AS spread, unnest(range(0, 200)) AS j FROM laws)),
    walked AS (SELECT *, sum(p) OVER (PARTITION BY entity, stat, season ORDER BY j) AS f FROM terms),
    rows AS (SELECT entity, team, season, stat, x, min(j) FILTER (f >= 0.25 - 1e-12) AS p25, min(j) FILTER (f >= 0.5 - 1e-12) AS median, min(j) FILTER (f >= 0.75 - 1e-12) AS p75,
                    coalesce(sum(p) FILTER (j < x), 0) + sum(p) FILTER (j = x) / 2 AS pit, list(f ORDER BY j) AS fs FROM walked GROUP BY ALL),
    scored AS (SELECT *, greatest(0.0, 1 - fs[CASE WHEN stat = 'urgent' THEN 1 ELSE median + 1 END]) AS p_event, x > CASE WHEN stat = 'urgent' THEN 0 ELSE median END AS event FROM rows)
    SELECT team, stat, count(*)::BIGINT AS n, round(avg(abs(x - median)), 5) AS mae, round(avg((x BETWEEN p25 AND p75)::INT), 6) AS coverage, round(avg((p25 = p75)::INT), 6) AS degenerate, round(avg((p_event - event::INT) ** 2), 6) AS brier,
           round(avg(event::INT), 6) AS event_rate, round(avg(p_event), 6) AS p_event, round(avg(pit), 6) AS mean_pit, round(avg((round(pit, 9) BETWEEN 0.25 AND 0.75)::INT), 6) AS middle FROM scored GROUP BY 1, 2""")
def count_scorecard(spark, sf_dir):
    """Each year's counts against their laws: the yes-or-no count by "any", the other by "over the median"."""
    rows = count_laws(spark, sf_dir)
    spread = scaled_variance(F.lit(1.0))
    law, x = laws.spread_law(F.col("m"), spread), F.col("x")
    rows = rows.withColumn("q", laws.quantiles([0.25, 0.5, 0.75], law, F.col("m"), F.coalesce(spread, F.col("m")))).withColumn("pit", laws.mid_pit(x, law))
    rows = rows.withColumn("line", F.when(F.col("stat") == "urgent", 0.0).otherwise(F.col("q")[1])).withColumn("p_event", laws.over(F.col("line"), law))
    event, each = (x > F.col("line")).cast("int"), lambda c: c.cast("int")
    out = rows.groupBy("team", "stat").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(x - F.col("q")[1])).alias("mae"), F.avg(each(x.between(F.col("q")[0], F.col("q")[2]))).alias("coverage"), F.avg(each(F.col("q")[0] == F.col("q")[2])).alias("degenerate"),
        F.avg(F.pow(F.col("p_event") - event, F.lit(2))).alias("brier"), F.avg(event).alias("event_rate"), F.avg("p_event").alias("p_event"), F.avg("pit").alias("mean_pit"), F.avg(each(F.round("pit", 9).between(0.25, 0.75))).alias("middle"))
    return rounded(rounded(out, "coverage", "degenerate", "brier", "event_rate", "p_event", "mean_pit", "middle"), "mae", digits=5)


@query(f"""WITH {COUNT_LAWS},
    grid AS (SELECT unnest([{", ".join(map(str, GRID))}])::DOUBLE AS scale),
    spreads AS (SELECT *, {_SPREAD.format("scale")} AS spread FROM laws, grid),
    masses AS (SELECT *, {mass_sql("x", "spread")} AS here, coalesce(list_sum(list_transform(range(0, x::BIGINT), lambda j: {mass_sql("j", "spread")})), 0) AS below FROM spreads),
    hits AS (SELECT *, (round(below + here / 2, 9) BETWEEN 0.25 AND 0.75)::INT AS middle, (round(below + here, 9) >= 0.25 AND round(below, 9) < 0.75)::INT AS inside FROM masses),
    cells AS (SELECT team, stat, scale, count(*)::BIGINT AS n, sum(middle) AS middle, sum(inside) AS inside, bool_and(wide) AS wide FROM hits GROUP BY 1, 2, 3
              UNION ALL SELECT NULL, stat, scale, count(*)::BIGINT, sum(middle), sum(inside), bool_and(wide) FROM hits GROUP BY 2, 3),
    shares AS (SELECT *, CASE WHEN wide THEN inside ELSE middle END / n AS share FROM cells),
    best AS (SELECT team, stat, max(n) AS n, arg_min(scale, (round(abs(share - 0.5), 9), (scale <> 1)::INT, scale)) AS scale, max(share) FILTER (scale = 1) AS before, arg_min(share, (round(abs(share - 0.5), 9), (scale <> 1)::INT, scale)) AS after FROM shares GROUP BY 1, 2)
    SELECT own.team, own.stat, own.n, own.n < 60 AS borrowed, CASE WHEN own.n < 60 THEN every.scale ELSE own.scale END AS scale, round(CASE WHEN own.n < 60 THEN every.before ELSE own.before END, 6) AS before,
           round(CASE WHEN own.n < 60 THEN every.after ELSE own.after END, 6) AS after FROM best own JOIN best every ON every.stat = own.stat AND every.team IS NULL WHERE own.team IS NOT NULL""")
def width_by_pit(spark, sf_dir):
    """The variance scale of each cell whose middle half holds nearest to half of the years.

    Middle: the mid-PIT between 1/4 and 3/4, which a true law holds half of, whatever its support; where every law of a cell is
    wide, the years between the quartiles. 1.0 stays unless another scale is nearer; cells with fewer than 60 rows borrow the
    scale of their statistic over all teams. All scales of a row come from one array, so rows are read once."""
    scales = F.array(*[F.struct(F.lit(s).alias("scale"), scaled_variance(F.lit(s)).alias("spread")) for s in GRID])
    rows = count_laws(spark, sf_dir).select("team", "stat", "x", "m", "wide", F.explode(scales).alias("s")).select("team", "stat", "x", "m", "wide", "s.*")
    rows = rows.withColumn("at", laws.mass_at(F.col("x"), laws.spread_law(F.col("m"), F.col("spread"))))
    below, here = F.col("at.below"), F.col("at.here")
    middle, inside = F.round(below + here / 2, 9).between(0.25, 0.75), (F.round(below + here, 9) >= 0.25) & (F.round(below, 9) < 0.75)
    sums = {"n": F.count(F.lit(1)), "middle": F.sum(middle.cast("int")), "inside": F.sum(inside.cast("int")), "wide": F.min("wide")}
    cells = save(rows.groupBy("team", "stat", "scale").agg(*[c.alias(k) for k, c in sums.items()]), "width-cells")
    whole = cells.groupBy("stat", "scale").agg(*[F.sum(c).alias(c) for c in ("n", "middle", "inside")], F.min("wide").alias("wide"))

    def best(df: DataFrame, *key: str) -> DataFrame:
        share = F.when(F.col("wide"), F.col("inside")).otherwise(F.col("middle")) / F.col("n")
        df = df.withColumn("share", share).withColumn("place", F.struct(F.round(F.abs(F.col("share") - TARGET), 9).alias("gap"), (F.col("scale") != 1).alias("moved"), "scale"))
        return df.groupBy(*key).agg(F.max("n").alias("n"), F.min("place").getField("scale").alias("scale"), F.max(F.when(F.col("scale") == 1, F.col("share"))).alias("before"), F.min_by("share", "place").alias("after"))

    own, every = best(cells, "team", "stat"), best(whole, "stat").select("stat", *[F.col(c).alias(f"all_{c}") for c in ("scale", "before", "after")])
    few = F.col("n") < LEAST_ROWS
    out = own.join(F.broadcast(every), "stat").select("team", "stat", "n", few.alias("borrowed"), *[F.when(few, F.col(f"all_{c}")).otherwise(F.col(c)).alias(c) for c in ("scale", "before", "after")])  # a row for each statistic
    return rounded(out, "before", "after")


RETURNED = """
    returned AS (SELECT o_orderpriority AS mode, o_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)::DOUBLE AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mode, x): quantity returned of each order, often none, by priority."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).cast("double").alias("x"))
    return lines.join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("mode")), "o_orderkey").select("mode", "x")


@query(f"""WITH {RETURNED},
    sizes AS (SELECT mode, count(*)::BIGINT AS n, avg((x <= 0)::INT) AS zero FROM returned GROUP BY 1),
    placed AS (SELECT mode, x, row_number() OVER (PARTITION BY mode ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY mode) AS size FROM returned WHERE x > 0),
    thinned AS (SELECT mode, list(x ORDER BY x) AS support FROM placed WHERE size <= 50 OR k IN (SELECT (i * (size - 1)) // 49 FROM range(50) r(i)) GROUP BY 1),
    laws AS (SELECT mode, n, zero, coalesce(support, []) AS support FROM sizes LEFT JOIN thinned USING (mode))
    SELECT mode, n, round(zero, 6) AS zero, len(support)::BIGINT AS points, {", ".join(f"CASE WHEN zero >= {q} THEN 0.0 ELSE support[greatest(1, ceil(({q} - zero) / (1 - zero) * len(support) - 1e-9)::INT)] END AS p{int(100 * q)}" for q in (0.25, 0.5, 0.9))},
           {", ".join(f"round((1 - zero) * len(list_filter(support, lambda v: v > {line})) / greatest(1, len(support)), 6) AS over_{line}" for line in (0, 20, 40))},
           round(1 - exp(-5 * (1 - zero) * len(list_filter(support, lambda v: v > 40)) / greatest(1, len(support))), 6) AS largest_of_5_over_40 FROM laws""")
def empirical_law(spark, sf_dir):
    """Quantity returned by priority as an empirical law: mass at zero, sorted values thinned to fifty; quantiles, chances to beat
    lines, and the chance that the largest of a Poisson number of orders, five on average, does."""
    rows = save(laws.empirical(save(returned(spark, sf_dir), "returned"), ["mode"], "x", points=50), "empirical")
    zero, support = F.col("zero"), F.col("support")
    beats = lambda line: laws.empirical_over(F.lit(float(line)), zero, support)
    return rows.select(
        "mode", "n", F.round("zero", 6).alias("zero"), F.size("support").cast("long").alias("points"), *[laws.empirical_quantile(q, zero, support).alias(f"p{int(100 * q)}") for q in (0.25, 0.5, 0.9)],
        *[F.round(beats(line), 6).alias(f"over_{line}") for line in (0, 20, 40)], F.round(1 - F.exp(-5 * beats(40)), 6).alias("largest_of_5_over_40"))


def _simpson(f: str, low: str, high: str, n: int = 2000) -> str:
    """Simpson's rule of f(t) with t as ``$t``."""
    at = lambda k: f.replace("$t", f"({low} + ({high} - {low}) * {k} / {n}.0)")
    return f"(({high} - {low}) / {3 * n}.0 * ({at(0)} + {at(n)} + list_sum(list_transform(range(1, {n}), lambda k: (CASE WHEN k % 2 = 1 THEN 4 ELSE 2 END) * {at('k')}))))"


MOMENTS = """
    amounts AS (SELECT c_mktsegment AS segment, avg(o_totalprice / 1000) AS m, var_samp(o_totalprice / 1000) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
    rates AS (SELECT c_mktsegment AS segment, avg(rate) AS m, var_samp(rate) AS v FROM (SELECT l_orderkey, avg(l_discount) * 10 AS rate FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1),
    fitted AS (SELECT amounts.segment, amounts.m * amounts.m / amounts.v AS shape, amounts.v / amounts.m AS scale, amounts.m AS mean, rates.m * (rates.m * (1 - rates.m) / rates.v - 1) AS a, (1 - rates.m) * (rates.m * (1 - rates.m) / rates.v - 1) AS b FROM amounts JOIN rates USING (segment))"""
_GAMMA = "exp((shape - 1) * ln(greatest($t, 1e-300)) - $t - lgamma(shape))"
_BETA = "exp(lgamma(a + b) - lgamma(a) - lgamma(b) + (a - 1) * ln(greatest($t, 1e-300)) + (b - 1) * ln(greatest(1 - $t, 1e-300)))"


@query(f"""WITH {MOMENTS}
    SELECT segment, round(shape, 5) AS shape, round(scale, 4) AS scale, round(a, 5) AS a, round(b, 5) AS b, {", ".join(f"round(1 - {_simpson(_GAMMA, '0.0', f'({c} * mean / scale)')}, 5) AS over_{name}" for c, name in ((0.5, "half"), (1, "mean"), (2, "double")))},
           {", ".join(f"round({_simpson(_BETA, '0.0', str(x))}, 5) AS rate_under_{int(10 * x)}" for x in (0.3, 0.5, 0.8))} FROM fitted""")
def continuous_laws(spark, sf_dir):
    """Order values as a gamma law and mean discounts as a beta law of each segment, fitted by moments, with chances at a few lines."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    orders = save(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000).alias("x")).join(people, "o_custkey"), "segment-orders")
    amounts = orders.groupBy("segment").agg(F.avg("x").alias("mean"), F.var_samp("x").alias("v"))
    rates = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.avg("l_discount") * 10).alias("rate")).join(orders.select("o_orderkey", "segment"), "o_orderkey")
    rates = rates.groupBy("segment").agg(F.avg("rate").alias("rm"), F.var_samp("rate").alias("rv"))
    size = F.col("rm") * (1 - F.col("rm")) / F.col("rv") - 1
    rows = amounts.join(rates, "segment").select("segment", "mean", (F.col("mean") * F.col("mean") / F.col("v")).alias("shape"), (F.col("v") / F.col("mean")).alias("scale"), (F.col("rm") * size).alias("a"), ((1 - F.col("rm")) * size).alias("b"))
    over = lambda c: F.round(1 - laws.gamma_cdf(c * F.col("mean"), F.col("shape"), F.col("scale")), 5)
    under = lambda x: F.round(laws.beta_cdf(F.lit(x), F.col("a"), F.col("b")), 5)
    return rows.select("segment", F.round("shape", 5).alias("shape"), F.round("scale", 4).alias("scale"), F.round("a", 5).alias("a"), F.round("b", 5).alias("b"), over(0.5).alias("over_half"), over(1).alias("over_mean"), over(2).alias("over_double"), *[under(x).alias(f"rate_under_{int(10 * x)}") for x in (0.3, 0.5, 0.8)])


@query(f"""WITH {COUNT_LAWS},
    means AS (SELECT entity, season, max(m) FILTER (stat = 'orders') AS a, max(m) FILTER (stat = 'urgent') AS b FROM laws GROUP BY 1, 2 HAVING count(*) = 2),
    sums AS (SELECT entity, season, sum(exp(i * ln(a) - a - lgamma(i + 1)) * exp(j * ln(b) - b - lgamma(j + 1))) FILTER (i + 3 * j <= floor(a + 3 * b)) AS under FROM means, range(60) x(i), range(20) y(j) WHERE i + 3 * j <= floor(a + 3 * b) GROUP BY 1, 2)
    SELECT entity, season, round(1 - under, 6) AS p_over FROM sums""")
def weighted_points_law(spark, sf_dir):
    """An entity's points of a year, one for an order and three more for an urgent one, as a sum of independent counts: the chance to beat their mean."""
    rows = count_laws(spark, sf_dir).groupBy("entity", "season").agg(F.max(F.when(F.col("stat") == "orders", F.col("m"))).alias("a"), F.max(F.when(F.col("stat") == "urgent", F.col("m"))).alias("b"), F.count(F.lit(1)).alias("k")).filter("k = 2")
    chance = laws.weighted_sum_over(F.col("a") + 3 * F.col("b"), F.lit(3), laws.poisson(F.col("b")), laws.poisson(F.col("a")), 10_000)
    return rows.select("entity", "season", F.round(chance, 6).alias("p_over"))
