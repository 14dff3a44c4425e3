"""Distribution fits, shrunk rates, regressions, projections, scorecards and calibration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dist, scalar
from ..operators import aggregates, asof, fits, rank
from ..shared import importable, table
from . import ratings
from .registry import big, query, rounded

COUNTS = """
    monthly AS (SELECT o_custkey, year(o_orderdate) AS y, count(*)::DOUBLE AS x FROM orders GROUP BY 1, 2),
    moments AS (SELECT o_custkey, count(*)::BIGINT AS n, avg(x) AS m, var_samp(x) AS v FROM monthly GROUP BY 1 HAVING count(*) >= 3 AND avg(x) > 0)"""


def moments(spark, sf_dir):
    """Mean and variance of a customer's yearly order counts, for three years or more. Sums of whole numbers are exact, so the
    variance does not depend on the order of the years."""
    yearly = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    sums = yearly.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).filter("n >= 3 AND s > 0")
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    return sums.select("o_custkey", "n", (s / n).alias("m"), ((n * q - s * s) / (n * (n - 1))).alias("v"))


@query(f"""WITH {COUNTS}, a AS (SELECT c_mktsegment AS segment, greatest(0.02, (v - m) / (m * m)) AS alpha FROM moments JOIN customer ON o_custkey = c_custkey)
    SELECT segment, round(median(alpha), 6) AS alpha, count(*)::BIGINT AS n FROM a GROUP BY 1 HAVING count(*) >= 8""")
def within_entity_alpha(spark, sf_dir):
    """A segment's over-dispersion: the median of its entities' own."""
    rows = moments(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey")
    rows = rows.withColumn("alpha", dist.alpha_from_moments(F.col("m"), F.col("v")))
    return rows.groupBy("segment").agg(F.round(F.median("alpha"), 6).alias("alpha"), F.count(F.lit(1)).alias("n")).filter("n >= 8")


@query(f"""WITH {COUNTS} SELECT o_custkey, round(1 / least(1e4, greatest(1e-3, (greatest(v, 1.05 * m) - m) / (m * m))), 5) AS r,
    round((1 / least(1e4, greatest(1e-3, (greatest(v, 1.05 * m) - m) / (m * m)))) / (1 / least(1e4, greatest(1e-3, (greatest(v, 1.05 * m) - m) / (m * m))) + m), 6) AS p,
    CASE WHEN v / m > 1.3 THEN 'nb' ELSE 'poisson' END AS family FROM moments""")
def nb_params(spark, sf_dir):
    m, v = F.col("m"), F.col("v")
    return moments(spark, sf_dir).select("o_custkey", F.round(dist.nb_r(m, v), 5).alias("r"), F.round(dist.nb_p(m, v), 6).alias("p"), dist.count_family(m, v).alias("family"))


@query(f"WITH {COUNTS} SELECT o_custkey, round(m, 6) AS rate, round(1 - exp(-m), 6) AS p_any, round(exp(-m), 6) AS p_none, round(1 - exp(-m) - m * exp(-m), 6) AS p_over_1 FROM moments")
def poisson_bernoulli_fit(spark, sf_dir):
    m = F.col("m")
    return rounded(moments(spark, sf_dir).select("o_custkey", m.alias("rate"), dist.anytime(m).alias("p_any"), F.exp(-m).alias("p_none"), (1 - F.exp(-m) - m * F.exp(-m)).alias("p_over_1")), "rate", "p_any", "p_none", "p_over_1")


@query(f"""WITH {COUNTS}, q AS (SELECT *, least(1.0, n / 7.0) AS p, 0.9::DOUBLE AS s FROM moments)
    SELECT o_custkey, round(p * s * m, 6) AS mean, round(p * (s * s * v + s * s * m * m) - (p * s * m) * (p * s * m), 6) AS variance FROM q""")
def mixture_moments(spark, sf_dir):
    """Mean and variance when the entity takes part with probability p, at a share s."""
    p, s, m, v = F.least(F.lit(1.0), F.col("n") / 7.0), F.lit(0.9), F.col("m"), F.col("v")
    return rounded(moments(spark, sf_dir).select("o_custkey", dist.mixture_mean(p, s, m).alias("mean"), dist.mixture_variance(p, s, m, v).alias("variance")), "mean", "variance")


@query("""WITH r AS (SELECT p_brand, p_partkey, sum(l_quantity) AS vol, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS num FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
    SELECT p_brand, round(sum(num) / sum(vol), 6) AS prior, count(*)::BIGINT AS n FROM r WHERE vol >= 100 GROUP BY 1""")
def rate_prior_floors(spark, sf_dir):
    """Prior rates from entities above a floor of volume."""
    rows = returns(spark, sf_dir).filter("vol >= 100")
    return rows.groupBy("p_brand").agg(F.round(F.sum("num") / F.sum("vol"), 6).alias("prior"), F.count(F.lit(1)).alias("n"))


def returns(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("vol"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("num"))
    return own.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").withColumnRenamed("l_partkey", "p_partkey")


@query("""WITH r AS (SELECT p_brand, p_partkey, sum(l_quantity) AS vol, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS num FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    b AS (SELECT p_brand, sum(num) / sum(vol) AS prior, 3 * avg(vol) AS pw FROM r WHERE vol >= 100 GROUP BY 1)
    SELECT p_partkey, round((num + coalesce(prior, 0.25) * coalesce(pw, 300)) / (vol + coalesce(pw, 300)), 6) AS rate FROM r LEFT JOIN b USING (p_brand)""")
def shrunk_rate(spark, sf_dir):
    rows = returns(spark, sf_dir)
    prior = rows.filter("vol >= 100").groupBy("p_brand").agg((F.sum("num") / F.sum("vol")).alias("prior"), (3 * F.avg("vol")).alias("pw"))
    w, p = F.coalesce("pw", F.lit(300.0)), F.coalesce("prior", F.lit(0.25))
    return rows.join(prior, "p_brand", "left").select("p_partkey", F.round((F.col("num") + p * w) / (F.col("vol") + w), 6).alias("rate"))


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice / 1000, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice / 1000, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice / 1000, l_quantity), 5) AS r2, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 100""")
def linear_fit_sums(spark, sf_dir):
    y, x = F.col("l_extendedprice") / 1000, F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n")).filter("n >= 100")
    return rounded(rounded(rows, "slope", "r2", digits=5), "intercept", digits=4)


@query("""WITH o AS (SELECT o_custkey, avg(o_totalprice) / 1000 AS price, count(*)::DOUBLE AS n FROM orders GROUP BY 1)
    SELECT c_custkey, round(greatest(35.0, 20 + 0.3 * price + 0.5 * n), 4) AS volume, round(least(0.8, greatest(0.3, 0.5 + c_acctbal / 20000)), 9) AS share, round(greatest(6.0, n * 0.4), 4) AS drives
    FROM customer JOIN o ON o_custkey = c_custkey""")
def environment_clamped_score(spark, sf_dir):
    """Linear scores held within bounds."""
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.avg("o_totalprice") / 1000).alias("price"), F.count(F.lit(1)).cast("double").alias("n"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(own, "c_custkey")
    volume = F.greatest(F.lit(35.0), 20 + 0.3 * F.col("price") + 0.5 * F.col("n"))
    out = rows.select("c_custkey", volume.alias("volume"), scalar.clip(0.5 + F.col("c_acctbal") / 20000, 0.3, 0.8).alias("share"), F.greatest(F.lit(6.0), F.col("n") * 0.4).alias("drives"))
    return rounded(rounded(out, "volume", "drives", digits=4), "share", digits=9)


@query("""SELECT o_orderkey, round(total / 2 + spread / 2, 6) AS implied_home, round(total / 2 - spread / 2, 6) AS implied_away, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE wind END AS wind
    FROM (SELECT o_orderkey, o_orderstatus, o_totalprice / 1000 AS total, (o_custkey % 15)::DOUBLE - 7 AS spread, (o_orderkey % 30)::DOUBLE AS wind FROM orders)""")
def implied_totals(spark, sf_dir):
    total, spread = F.col("o_totalprice") / 1000, (F.col("o_custkey") % 15).cast("double") - 7
    wind = F.when(F.col("o_orderstatus") == "F", 0.0).otherwise((F.col("o_orderkey") % 30).cast("double"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(total / 2 + spread / 2, 6).alias("implied_home"), F.round(total / 2 - spread / 2, 6).alias("implied_away"), wind.alias("wind"))


@query("""SELECT round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) / sum(l_quantity), 6) AS return_rate, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 6) AS discount_rate,
    round(count(CASE WHEN l_linestatus = 'O' THEN 1 END)::DOUBLE / count(*), 6) AS open_rate, round(sum(l_quantity) / count(DISTINCT l_orderkey), 4) AS per_order FROM lineitem""")
def measured_constants(spark, sf_dir):
    q = F.col("l_quantity")
    one = table(spark, sf_dir, "lineitem").agg(
        F.round(F.sum(F.when(F.col("l_returnflag") == "R", q)) / F.sum(q), 6).alias("return_rate"), F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_extendedprice"), 6).alias("discount_rate"),
        F.round(F.count(F.when(F.col("l_linestatus") == "O", 1)) / F.count(F.lit(1)), 6).alias("open_rate"), F.round(F.sum(q) / F.countDistinct("l_orderkey"), 4).alias("per_order"),
    )
    return one


SCORED = """
    h AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS season, o_totalprice / 1000 AS actual, avg(o_totalprice / 1000) OVER w AS m, stddev_samp(o_totalprice / 1000) OVER w AS sd, count(*) OVER w AS k, list(o_totalprice / 1000) OVER w AS eight
          FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
    scored AS (SELECT season, actual, m AS projected_median, m - 0.6745 * sd AS projected_p25, m + 0.6745 * sd AS projected_p75, len(list_filter(eight, lambda x: x > m)) / 8.0 AS p_over_median, 1 / (1 + exp(-1.702 * (actual - m) / nullif(sd, 0))) AS pit FROM h WHERE k = 8)"""


def scored(spark, sf_dir):
    """Each order projected from the eight strictly before it."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.year("o_orderdate").alias("season"), (F.col("o_totalprice") / 1000).alias("actual"))
    w = asof.trailing(["o_custkey"], ["o_orderdate", "o_orderkey"], 8)
    rows = rows.withColumns({"m": F.avg("actual").over(w), "sd": F.stddev_samp("actual").over(w), "k": F.count("actual").over(w), "eight": F.collect_list("actual").over(w)}).filter("k = 8")
    m, sd = F.col("m"), F.col("sd")
    above = F.size(F.filter("eight", lambda x: x > F.col("m"))) / 8.0  # the law of the eight values themselves
    return rows.select("season", "actual", m.alias("projected_median"), (m - 0.6745 * sd).alias("projected_p25"), (m + 0.6745 * sd).alias("projected_p75"), above.alias("p_over_median"), (1 / (1 + F.exp(-1.702 * (F.col("actual") - m) / F.nullif(sd, F.lit(0.0))))).alias("pit"), m.alias("m"), sd.alias("sd"))


@query(f"""WITH {SCORED} SELECT count(*)::BIGINT AS n, round(avg(abs(projected_median - actual)), 5) AS mae, round(avg(projected_median - actual), 5) AS bias,
    round(avg(CASE WHEN actual BETWEEN projected_p25 AND projected_p75 THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(power(p_over_median - CASE WHEN actual > projected_median THEN 1.0 ELSE 0.0 END, 2)), 6) AS brier,
    round(median(projected_median), 4) AS median_projected, round(median(actual), 4) AS median_actual, round(avg(CASE WHEN actual > projected_median THEN 1.0 ELSE 0.0 END), 6) AS over_rate,
    round(avg(CASE WHEN projected_p25 = projected_p75 THEN 1.0 ELSE 0.0 END), 6) AS degenerate_rate, round(avg(pit), 5) AS pit_mean FROM scored""")
def scorecard(spark, sf_dir):
    out = scored(spark, sf_dir).agg(*[c.alias(k) for k, c in aggregates.scorecard().items()])
    out = rounded(out, "coverage", "brier", "over_rate", "degenerate_rate")
    return rounded(rounded(out, "mae", "bias", "pit_mean", digits=5), "median_projected", "median_actual", digits=4)


@query(f"""WITH {SCORED} SELECT season::BIGINT AS season, count(*)::BIGINT AS n, round(avg(CASE WHEN actual BETWEEN projected_p25 AND projected_p75 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM scored GROUP BY 1""")
def coverage_by_period(spark, sf_dir):
    inside = F.when(F.col("actual").between(F.col("projected_p25"), F.col("projected_p75")), 1.0).otherwise(0.0)
    return scored(spark, sf_dir).groupBy(big(F.col("season")).alias("season")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(inside), 6).alias("coverage"))


@query(f"""WITH {SCORED} SELECT season::BIGINT AS season, round(least(1.4, greatest(0.7, 1 + (avg(actual) / avg(projected_median) - 1) * count(*) / (count(*) + 60.0))), 6) AS ratio FROM scored GROUP BY 1""")
def bias_ratio(spark, sf_dir):
    """Actual over projected, shrunk to 1 by 60 rows and held within bounds."""
    n = F.count(F.lit(1))
    value = 1 + (F.avg("actual") / F.avg("projected_median") - 1) * n / (n + 60.0)
    return scored(spark, sf_dir).groupBy(big(F.col("season")).alias("season")).agg(F.round(scalar.clip(value, 0.7, 1.4), 6).alias("ratio"))


@query(f"""WITH {SCORED}, grid AS (SELECT unnest([0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 2.5])::DOUBLE AS scale),
    c AS (SELECT season, scale, avg(CASE WHEN abs(actual - projected_median) <= scale * (projected_p75 - projected_median) THEN 1.0 ELSE 0.0 END) AS coverage, count(*) AS n FROM scored, grid GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY round(abs(coverage - 0.5), 9), abs(scale - 1), scale) AS k FROM c WHERE n >= 60)
    SELECT season::BIGINT AS season, scale, round(coverage, 6) AS coverage FROM k WHERE k = 1""")
def width_grid(spark, sf_dir):
    """The interval width, from a grid, whose coverage is nearest to one half; each row is weighed against the grid in one aggregate."""
    grid = [0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 2.5]
    off, half = F.abs(F.col("actual") - F.col("projected_median")), F.col("projected_p75") - F.col("projected_median")
    rows = scored(spark, sf_dir).groupBy("season").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.when(off <= s * half, 1.0).otherwise(0.0)).alias(f"c{k}") for k, s in enumerate(grid)]).filter("n >= 60")
    options = F.array_sort(F.array(*[F.struct(F.round(F.abs(F.col(f"c{k}") - 0.5), 9).alias("miss"), F.lit(abs(s - 1)).alias("off"), F.lit(s).alias("scale"), F.col(f"c{k}").alias("coverage")) for k, s in enumerate(grid)]))
    return rows.select(big(F.col("season")).alias("season"), options[0].scale.alias("scale"), F.round(options[0].coverage, 6).alias("coverage"))


@query(f"""WITH {SCORED}, p AS (SELECT avg(CASE WHEN actual > projected_median THEN 1.0 ELSE 0.0 END) AS p, season FROM scored GROUP BY 2)
    SELECT season::BIGINT AS season, round(p, 6) AS p, CASE WHEN p > 0 AND p < 1 THEN CASE WHEN p >= 0.5 THEN -round(100 * p / (1 - p)) ELSE round(100 * (1 - p) / p) END END::BIGINT AS odds,
    round(-(p * ln(p) + (1 - p) * ln(1 - p)), 6) AS entropy FROM p WHERE p > 0 AND p < 1""")
def fair_odds(spark, sf_dir):
    p = F.avg(F.when(F.col("actual") > F.col("projected_median"), 1.0).otherwise(0.0))
    rows = scored(spark, sf_dir).groupBy(big(F.col("season")).alias("season")).agg(p.alias("p")).filter("p > 0 AND p < 1")
    return rows.select("season", F.round("p", 6).alias("p"), scalar.american_odds(F.col("p")).alias("odds"), F.round(scalar.log_loss(F.col("p"), F.col("p")), 6).alias("entropy"))


@query(f"""WITH {COUNTS}, s AS (SELECT o_custkey, m, least(1.0, n / 7.0) AS p, m * least(1.0, n / 7.0) AS played, m * least(1.0, n / 7.0) * 0.9 AS shared FROM moments)
    SELECT o_custkey, 0::BIGINT AS step, 'base' AS name, round(m, 6) AS value FROM s UNION ALL SELECT o_custkey, 1, 'participation', round(played, 6) FROM s UNION ALL SELECT o_custkey, 2, 'share', round(shared, 6) FROM s""")
def explain_trace(spark, sf_dir):
    """A projection as its chain of named steps, a row for each."""
    p = F.least(F.lit(1.0), F.col("n") / 7.0)
    steps = [("base", F.col("m")), ("participation", F.col("m") * p), ("share", F.col("m") * p * 0.9)]
    chain = F.array(*[F.struct(F.lit(n).alias("name"), F.round(v, 6).alias("value")) for n, v in steps])
    return moments(spark, sf_dir).select("o_custkey", F.posexplode(chain).alias("step", "s")).select("o_custkey", big(F.col("step")).alias("step"), "s.*")


@query("""WITH p AS (SELECT l_partkey, avg(CASE WHEN l_quantity > 45 THEN 1.0 ELSE 0.0 END) AS tail, count(*) / 12.0 AS n FROM lineitem GROUP BY 1)
    SELECT l_partkey, round(1 - exp(-n * tail), 6) AS p_longest_over, round(exp(-n), 6) AS p_none FROM p""")
def longest_over(spark, sf_dir):
    """The chance that the largest of a period's values exceeds a line, in closed form, with its mass at none."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.avg(F.when(F.col("l_quantity") > 45, 1.0).otherwise(0.0)).alias("tail"), (F.count(F.lit(1)) / 12.0).alias("n"))
    return rows.select("l_partkey", F.round(dist.longest_over(F.col("n"), F.col("tail")), 6).alias("p_longest_over"), F.round(F.exp(-F.col("n")), 6).alias("p_none"))


@query("""WITH a AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE user_id % 2 = 0),
    t AS (SELECT event_type, value AS matched, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS m FROM events WHERE user_id % 2 = 1),
    s AS (SELECT event_type, max(m) AS m FROM t GROUP BY 1)
    SELECT event_id, matched FROM a JOIN s USING (event_type) JOIN t ON t.event_type = a.event_type AND t.k = floor(a.r * s.m * 1.0 / a.n)""")
def marginal_match(spark, sf_dir):
    """Values take another sample's distribution and keep their own order."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    out = rank.match_marginal(events.filter("user_id % 2 = 0"), ["event_type"], "value", "event_id", events.filter("user_id % 2 = 1"), "value", "matched")
    return out.select("event_id", "matched")


#: The penalised normal equations by block Gauss-Seidel, sixty times: faced effects, rated effects (the solution's are centred), the mean.
TWOWAY_SQL = f"""WITH RECURSIVE {ratings.FACTS},
    aged AS (SELECT *, denominator * 0.5 ** ((max(period) OVER (PARTITION BY metric) - period) / 17.0) AS w FROM facts WHERE denominator > 0),
    cells AS (SELECT metric, team, opponent, sum(w) * any_value(scale) AS w, sum(w * numerator / denominator) * any_value(scale) AS wy
              FROM (SELECT *, count(*) OVER (PARTITION BY metric) / sum(w) OVER (PARTITION BY metric) AS scale FROM aged) GROUP BY 1, 2, 3),
    it AS (SELECT 0 AS k, metric, team, 0.0::DOUBLE AS r, 0.0::DOUBLE AS f, 0.0::DOUBLE AS mu FROM (SELECT metric, team FROM cells UNION SELECT metric, opponent FROM cells)
        UNION ALL
        (WITH now AS (SELECT * FROM it),
         f1 AS (SELECT cells.metric, opponent AS team, sum(wy - w * (mu + r)) / (sum(w) + 25) AS f FROM cells JOIN now ON now.metric = cells.metric AND now.team = cells.team GROUP BY 1, 2),
         f2 AS (SELECT now.metric, now.team, coalesce(f1.f, 0) - avg(coalesce(f1.f, 0)) OVER (PARTITION BY now.metric) AS f FROM now LEFT JOIN f1 ON f1.metric = now.metric AND f1.team = now.team),
         r1 AS (SELECT cells.metric, cells.team, sum(wy - w * (mu + f2.f)) / (sum(w) + 25) AS r FROM cells JOIN f2 ON f2.metric = cells.metric AND f2.team = opponent
                JOIN now ON now.metric = cells.metric AND now.team = cells.team GROUP BY 1, 2),
         r2 AS (SELECT now.metric, now.team, k, coalesce(r1.r, 0) - avg(coalesce(r1.r, 0)) OVER (PARTITION BY now.metric) AS r FROM now LEFT JOIN r1 ON r1.metric = now.metric AND r1.team = now.team),
         m2 AS (SELECT cells.metric, sum(wy - w * (r2.r + f2.f)) / sum(w) AS mu FROM cells JOIN f2 ON f2.metric = cells.metric AND f2.team = opponent JOIN r2 ON r2.metric = cells.metric AND r2.team = cells.team GROUP BY 1)
         SELECT k + 1, r2.metric, r2.team, r2.r, f2.f, m2.mu FROM r2 JOIN f2 USING (metric, team) JOIN m2 USING (metric) WHERE k < 60))
    SELECT metric, team, round(mu + avg(r) OVER g + avg(f) OVER g, 3) AS mean, round(r - avg(r) OVER g, 3) AS rated, round(f - avg(f) OVER g, 3) AS faced FROM it WHERE k = 60 WINDOW g AS (PARTITION BY metric)"""


@query(TWOWAY_SQL)
def twoway_ridge(spark, sf_dir):
    """Two-sided effects of a month's rates, penalised and centred."""
    importable(spark)
    games = ratings.facts(spark, sf_dir)
    last = Window.partitionBy("metric")
    return rounded(fits.two_way_ridge(games.withColumn("games_ago", (F.max("period").over(last) - F.col("period")).cast("double"))), "mean", "rated", "faced", digits=3)


_LINES = "x AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem)"
#: Normal equations on covariances, solved by determinants.
LEAST_SQUARES_SQL = f"""WITH {_LINES},
    s AS (SELECT avg(y) AS my, avg(q) AS mq, avg(d) AS md, avg(t) AS mt, var_pop(y) AS yy, var_pop(q) AS qq, var_pop(d) AS dd, var_pop(t) AS tt, covar_pop(q, d) AS qd, covar_pop(q, t) AS qt, covar_pop(d, t) AS dt,
                 covar_pop(q, y) AS qy, covar_pop(d, y) AS dy, covar_pop(t, y) AS ty FROM x),
    det AS (SELECT *, qq * (dd * tt - dt * dt) - qd * (qd * tt - dt * qt) + qt * (qd * dt - dd * qt) AS det FROM s),
    b AS (SELECT *, (qy * (dd * tt - dt * dt) - qd * (dy * tt - dt * ty) + qt * (dy * dt - dd * ty)) / det AS bq,
                 (qq * (dy * tt - dt * ty) - qy * (qd * tt - dt * qt) + qt * (qd * ty - dy * qt)) / det AS bd,
                 (qq * (dd * ty - dy * dt) - qd * (qd * ty - dy * qt) + qy * (qd * dt - dd * qt)) / det AS bt FROM det),
    f AS (SELECT *, bq * qy + bd * dy + bt * ty AS explained FROM b)
    SELECT term, round(value, 4) AS value FROM (
        SELECT 'intercept' AS term, my - bq * mq - bd * md - bt * mt AS value FROM f UNION ALL SELECT 'quantity', bq FROM f UNION ALL SELECT 'discount', bd FROM f UNION ALL SELECT 'tax', bt FROM f
        UNION ALL SELECT 'r2', explained / yy FROM f UNION ALL SELECT 'rmse', sqrt(yy - explained) FROM f)"""


@query(LEAST_SQUARES_SQL)
def least_squares_fit(spark, sf_dir):
    """Price on quantity, discount and tax; coefficients as rows."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    beta, r2, rmse = fits.least_squares(rows, ["quantity", "discount", "tax"], "y")
    return rounded(spark.createDataFrame([*beta.items(), ("r2", r2), ("rmse", rmse)], "term string, value double"), "value", digits=4)


#: Newton's method on three coefficients, each step solved by determinants.
LOGISTIC_SQL = """WITH RECURSIVE x AS (SELECT (l_returnflag = 'R')::INT AS y, l_quantity / 50 AS q, l_discount AS d FROM lineitem),
    steps AS (SELECT 0 AS k, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2
        UNION ALL
        SELECT k + 1, b0 + (s0 * (c * f - e * e) - b * (s1 * f - e * s2) + g * (s1 * e - c * s2)) / det, b1 + (a * (s1 * f - e * s2) - s0 * (b * f - e * g) + g * (b * s2 - s1 * g)) / det,
               b2 + (a * (c * s2 - s1 * e) - b * (b * s2 - s1 * g) + s0 * (b * e - c * g)) / det
        FROM (SELECT *, a * (c * f - e * e) - b * (b * f - e * g) + g * (b * e - c * g) AS det FROM (
            SELECT k, b0, b1, b2, sum(y - p) AS s0, sum(q * (y - p)) AS s1, sum(d * (y - p)) AS s2, sum(p * (1 - p)) AS a, sum(q * p * (1 - p)) AS b, sum(d * p * (1 - p)) AS g,
                   sum(q * q * p * (1 - p)) AS c, sum(q * d * p * (1 - p)) AS e, sum(d * d * p * (1 - p)) AS f
            FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * q + b2 * d))) AS p FROM steps, x) GROUP BY k, b0, b1, b2)) WHERE k < 12)
    SELECT term, round(value, 4) AS value FROM (SELECT unnest(['intercept', 'quantity', 'discount']) AS term, unnest([b0, b1, b2]) AS value FROM steps WHERE k = 12)"""


@query(LOGISTIC_SQL)
def logistic_fit(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_quantity") / 50).alias("quantity"), F.col("l_discount").alias("discount"))
    return rounded(spark.createDataFrame(list(fits.logistic(rows, ["quantity", "discount"], "y").items()), "term string, value double"), "value", digits=4)


@query()
def monte_carlo_joint(spark, sf_dir):
    """Each entity's chance to beat its mean, and its group's joint and independent chance that all its entities do, from
    seeded shared-pace draws for every entity."""
    importable(spark)
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("grp"), F.col("c_custkey").cast("long").alias("entity")).join(moments(spark, sf_dir).select(F.col("o_custkey").cast("long").alias("entity"), "m"), "entity")
    rows = rows.select("grp", "entity", F.col("m").alias("rate"), F.lit(6.0).alias("shape"), F.crc32(F.concat_ws("|", F.lit("draws"), "grp").cast("binary")).alias("seed"))
    return fits.joint_over(rows, 1000)


@query(f"""WITH {COUNTS},
    families AS (SELECT o_custkey, m, CASE WHEN v / m > 1.3 THEN 'nb' ELSE 'poisson' END AS family, 1 / least(1e4, greatest(1e-3, (greatest(v, 1.05 * m) - m) / (m * m))) AS r FROM moments),
    terms AS (SELECT *, CASE family WHEN 'nb' THEN exp(lgamma(k + r) - lgamma(r) - lgamma(k + 1) + r * ln(r / (r + m)) + k * ln(m / (r + m))) ELSE exp(k * ln(m) - m - lgamma(k + 1)) END AS here
              FROM (SELECT *, unnest(range(0, 200)) AS k FROM families)),
    sums AS (SELECT *, sum(here) OVER (PARTITION BY o_custkey ORDER BY k) AS below FROM terms)
    SELECT o_custkey, family, min(k) FILTER (below >= 0.25 - 1e-12)::DOUBLE AS p25, min(k) FILTER (below >= 0.5 - 1e-12)::DOUBLE AS median, min(k) FILTER (below >= 0.75 - 1e-12)::DOUBLE AS p75,
           round(1 - sum(here) FILTER (k <= floor(m + 0.5 + 1e-9)), 6) AS p_over FROM sums GROUP BY 1, 2""")
def distribution_table(spark, sf_dir):
    """Median, quartiles and the chance to beat the line mean + 0.5 under each entity's fitted family."""
    m, v = F.col("m"), F.col("v")
    rows = moments(spark, sf_dir).withColumn("family", dist.count_family(m, v))
    rows = rows.withColumn("a", F.when(F.col("family") == "nb", dist.nb_r(m, v)).otherwise(m)).withColumn("b", F.when(F.col("family") == "nb", dist.nb_p(m, v)).otherwise(F.lit(1.0)))
    rows = rows.withColumn("q", dist.quantiles("family", "a", "b", [0.25, 0.5, 0.75]))
    return rows.select("o_custkey", "family", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), F.round(dist.p_over("family", "a", "b", m + 0.5), 6).alias("p_over"))
