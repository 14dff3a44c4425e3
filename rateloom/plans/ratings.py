"""Counterparty-adjusted rates: stacked facts, trailing rates, reliability, multipliers, adjusted logs.

A supplier's nation is the rated unit, a customer's nation the counterparty, a month the period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates, asof, rank, reshape
from ..shared import save, table
from .registry import big, query, rounded

WINDOW, PRIOR_GAMES = 8, 12.0

FACTS = """
    base AS (
        SELECT s_nationkey::BIGINT AS team, c_nationkey::BIGINT AS opponent, (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS period,
               sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_quantity) AS quantity,
               sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS returned, count(*)::DOUBLE AS lines
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
        GROUP BY 1, 2, 3),
    facts AS (
        SELECT team, opponent, period, 'net_price' AS metric, revenue AS numerator, quantity AS denominator FROM base
        UNION ALL SELECT team, opponent, period, 'return_rate', returned, quantity FROM base WHERE returned IS NOT NULL
        UNION ALL SELECT team, opponent, period, 'lines', lines, 1.0 FROM base)"""
TRAILING = FACTS + """,
    periods AS (SELECT team, metric, period, sum(numerator) AS numerator, sum(denominator) AS denominator FROM facts GROUP BY 1, 2, 3),
    rolled AS (
        SELECT *, sum(numerator) OVER w AS num8, sum(denominator) OVER w AS den8, count(numerator) OVER w AS n8
        FROM periods WINDOW w AS (PARTITION BY team, metric ORDER BY period ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
    recent_rates AS (SELECT team, metric, period, numerator, denominator, num8, den8, num8 / den8 AS rate FROM rolled WHERE n8 = 8 AND den8 > 0),
    league AS (SELECT metric, sum(num8) / sum(den8) AS league_rate FROM recent_rates GROUP BY 1)"""
MULTIPLIERS = FACTS + """,
    totals AS (SELECT team, metric, sum(numerator) AS numerator, sum(denominator) AS denominator, count(DISTINCT period) AS n FROM facts GROUP BY 1, 2),
    whole AS (SELECT metric, sum(numerator) / sum(denominator) AS league_rate FROM totals GROUP BY 1),
    multipliers AS (
        SELECT team, metric, n, CASE WHEN league_rate > 0 AND n > 0 THEN (n * (numerator / denominator) + 12.0 * league_rate) / (n + 12.0) / league_rate ELSE 1.0 END AS multiplier
        FROM totals JOIN whole USING (metric) WHERE denominator > 0)"""


def period():
    return F.year("o_orderdate") * 12 + F.month("o_orderdate")


def metrics():
    return {
        "net_price": (F.col("revenue"), F.col("quantity")),
        "return_rate": (F.col("returned"), F.col("quantity")),
        "lines": (F.col("lines"), F.lit(1.0)),
    }


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with rated unit, counterparty and period. The two large tables meet on the order key; the small ones follow as
    broadcasts where the planner's size estimate allows it."""
    t = lambda n, *c: table(spark, sf_dir, n).select(*c)
    lines = t("lineitem", "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    orders = t("orders", "o_orderkey", "o_custkey", "o_orderdate").join(t("customer", F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    rows = lines.join(t("supplier", F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return rows.join(orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").select(big(F.col("s_nationkey")).alias("team"), big(F.col("c_nationkey")).alias("opponent"), big(period()).alias("period"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")


def facts(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    """(team, opponent, period, metric, numerator, denominator): one aggregate over the lines, then unpivoted; of ``only`` these metrics, if any are named."""
    base = star(spark, sf_dir).groupBy("team", "opponent", "period").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.sum("l_quantity").alias("quantity"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("returned"), F.count(F.lit(1)).cast("double").alias("lines"),
    )
    return reshape.unpivot_pairs(base, ["team", "opponent", "period"], {k: v for k, v in metrics().items() if not only or k in only})


def trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = facts(spark, sf_dir).groupBy("team", "metric", "period").agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))
    frame = asof.trailing(["team", "metric"], ["period"], WINDOW)
    rows = periods.withColumn("num8", asof.trailing_sum("numerator", frame, WINDOW)).withColumn("den8", asof.trailing_sum("denominator", frame, WINDOW))
    return rows.filter("den8 > 0").withColumn("rate", F.col("num8") / F.col("den8"))


def with_league(rows: DataFrame) -> DataFrame:
    """The league's rate: sums over a metric's rows, of which there are teams times periods however many lines there are."""
    league = Window.partitionBy("metric")
    return rows.withColumn("league_rate", F.sum("num8").over(league) / F.sum("den8").over(league))


def multipliers(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    """(team, metric, n, multiplier): the raw rate shrunk to the league's by ``PRIOR_GAMES`` periods."""
    league = Window.partitionBy("metric")  # a row for each team
    totals = facts(spark, sf_dir, *only).groupBy("team", "metric").agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"), F.countDistinct("period").alias("n"))
    rows = totals.withColumn("league_rate", F.sum("numerator").over(league) / F.sum("denominator").over(league)).filter("denominator > 0")
    return rows.select("team", "metric", "n", rank.shrink_multiplier(F.col("n"), F.col("numerator") / F.col("denominator"), F.col("league_rate"), PRIOR_GAMES).alias("multiplier"))


@query(f"WITH {FACTS} SELECT team, opponent, period, metric, round(numerator, 4) AS numerator, round(denominator, 4) AS denominator FROM facts")
def unit_facts(spark, sf_dir):
    return rounded(facts(spark, sf_dir), "numerator", "denominator", digits=4)


@query(f"WITH {TRAILING} SELECT team, metric, period, round(rate, 6) AS rate, round(rate / league_rate, 6) AS relative FROM recent_rates JOIN league USING (metric)")
def trailing_rate(spark, sf_dir):
    rows = with_league(trailing(spark, sf_dir)).withColumn("relative", F.col("rate") / F.col("league_rate"))
    return rounded(rows.select("team", "metric", "period", "rate", "relative"), "rate", "relative")


@query(f"""WITH {TRAILING},
    xy AS (SELECT metric, rate / league_rate - 1 AS x, numerator / denominator / league_rate - 1 AS y, denominator AS w FROM recent_rates JOIN league USING (metric) WHERE denominator > 0 AND league_rate <> 0),
    fit AS (SELECT metric, greatest(0.0, least(1.0, sum(w * x * y) / nullif(sum(w * x * x), 0))) AS beta, count(*)::BIGINT AS n FROM xy GROUP BY 1)
    SELECT metric, n, round(beta, 5) AS beta, round(CASE WHEN beta <= 1e-6 THEN 1e6 ELSE 8.0 * (1 - beta) / beta END, 2) AS implied_k FROM fit""")
def metric_reliability(spark, sf_dir):
    rows = with_league(trailing(spark, sf_dir)).filter("denominator > 0 AND league_rate <> 0")
    rows = rows.select("metric", (F.col("rate") / F.col("league_rate") - 1).alias("x"), (F.col("numerator") / F.col("denominator") / F.col("league_rate") - 1).alias("y"), F.col("denominator").alias("w"))
    fit = aggregates.wls_origin(F.col("x"), F.col("y"), F.col("w"))
    out = rows.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in fit.items()])
    return rounded(rounded(out, "beta", digits=5), "implied_k", digits=2)


@query(f"WITH {MULTIPLIERS} SELECT team, metric, n::BIGINT AS n, round(multiplier, 6) AS multiplier FROM multipliers")
def multiplier_shrunk(spark, sf_dir):
    return rounded(multipliers(spark, sf_dir).withColumn("n", big(F.col("n"))), "multiplier")


@query(f"""WITH {MULTIPLIERS},
    m AS (SELECT team, metric, round(multiplier, 6) AS multiplier FROM multipliers)
    SELECT team, metric, multiplier,
           round(coalesce((multiplier - avg(multiplier) OVER g) / nullif(stddev_samp(multiplier) OVER g, 0), 0.0), 4) AS z,
           round((rank() OVER (PARTITION BY metric ORDER BY multiplier) + (count(*) OVER (PARTITION BY metric, multiplier) - 1) / 2.0) / count(*) OVER g, 6) AS percentile,
           (dense_rank() OVER (PARTITION BY metric ORDER BY multiplier DESC))::BIGINT AS place
    FROM m WINDOW g AS (PARTITION BY metric)""")
def multiplier_ranked(spark, sf_dir):
    """Flagship: scan, four joins, stacked facts, shrunk multipliers, then z-score, percentile and rank in each metric."""
    m = rounded(multipliers(spark, sf_dir).select("team", "metric", "multiplier"), "multiplier")
    m = m.withColumns({"z": rank.z_score("multiplier", ["metric"]), "percentile": rank.average_percentile("multiplier", ["metric"]), "place": rank.dense_rank_desc("multiplier", ["metric"])})
    return rounded(rounded(m, "percentile"), "z", digits=4)


@query(f"""WITH {MULTIPLIERS},
    pinned AS (SELECT team, metric, CASE WHEN metric = 'lines' THEN 1.0 WHEN n < 4 THEN 1.0 ELSE multiplier END AS multiplier,
                      CASE WHEN metric = 'lines' THEN 'pinned' WHEN n < 4 THEN 'pinned:no_signal' ELSE 'shrunk' END AS method FROM multipliers)
    SELECT team, metric, round(multiplier, 6) AS multiplier, method FROM pinned""")
def multiplier_assembled(spark, sf_dir):
    """The ordered choice of method: additive metrics are pinned, so are those without signal, the rest are shrunk."""
    rows = multipliers(spark, sf_dir)
    additive, silent = F.col("metric") == "lines", F.col("n") < 4
    method = F.when(additive, "pinned").when(silent, "pinned:no_signal").otherwise("shrunk")
    value = F.when(additive | silent, F.lit(1.0)).otherwise(F.col("multiplier"))
    return rounded(rows.select("team", "metric", value.alias("multiplier"), method.alias("method")), "multiplier")


@query(f"""WITH {MULTIPLIERS},
    log AS (SELECT o_custkey, o_orderkey, c_nationkey::BIGINT AS team, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS games_ago
            FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT o_custkey, o_orderkey, games_ago::BIGINT AS games_ago, round(o_totalprice / coalesce(multiplier, 1.0), 3) AS adjusted
    FROM log LEFT JOIN (SELECT team, multiplier FROM multipliers WHERE metric = 'net_price') USING (team) WHERE games_ago < 10""")
def adjusted_log(spark, sf_dir):
    """Values of the last ten orders, each divided by its counterparty's multiplier (1 where there is none)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    orders = asof.last_n(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 10)
    teams = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), big(F.col("c_nationkey")).alias("team"))
    own = multipliers(spark, sf_dir, "net_price").select("team", "multiplier")
    rows = orders.join(teams, "o_custkey").join(F.broadcast(own), "team", "left")  # a row for each nation
    return rows.select("o_custkey", "o_orderkey", big(F.col("games_ago")).alias("games_ago"), F.round(F.col("o_totalprice") / F.coalesce("multiplier", F.lit(1.0)), 3).alias("adjusted"))


@query(f"""WITH {FACTS},
    pairs AS (SELECT team, opponent, sum(numerator) AS revenue FROM facts WHERE metric = 'net_price' GROUP BY 1, 2),
    edges AS (SELECT least(team, opponent) AS a, greatest(team, opponent) AS b, sum(CASE WHEN team <= opponent THEN revenue ELSE -revenue END) AS net FROM pairs WHERE team <> opponent GROUP BY 1, 2)
    SELECT a, b, round(net, 5) AS net, round(-net, 5) AS net_back FROM edges""")
def orientation_pair(spark, sf_dir):
    """The balance of a pair whichever way it is written, and from the other side with its sign turned."""
    pairs = facts(spark, sf_dir, "net_price").filter("team != opponent").groupBy(F.col("team").alias("a"), F.col("opponent").alias("b")).agg(F.sum("numerator").alias("net"))
    pairs = save(pairs, "pairs")  # read four times
    keys = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    there = reshape.oriented(keys, pairs, "a", "b", "net")
    back = reshape.oriented(keys.select(F.col("b").alias("a"), F.col("a").alias("b")), pairs, "a", "b", "net").select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("net").alias("net_back"))
    return rounded(there.join(back, ["a", "b"]), "net", "net_back", digits=5)


@query(f"""WITH {FACTS},
    totals AS (SELECT team, metric, sum(numerator) / sum(denominator) AS rate, row_number() OVER (PARTITION BY metric ORDER BY round(sum(numerator) / sum(denominator), 6), team) AS low,
                      row_number() OVER (PARTITION BY metric ORDER BY round(sum(numerator) / sum(denominator), 6) DESC, team) AS high FROM facts GROUP BY 1, 2)
    SELECT team, metric, round(rate, 6) AS rate, CASE WHEN low <= 3 THEN 'low' ELSE 'high' END AS "end" FROM totals WHERE low <= 3 OR high <= 3""")
def head_tail(spark, sf_dir):
    rows = facts(spark, sf_dir).groupBy("team", "metric").agg(F.round(F.sum("numerator") / F.sum("denominator"), 6).alias("rate"))
    return rank.head_tail(rows, ["metric"], "rate", "team", 3)


@query(f"""WITH {FACTS},
    shares AS (SELECT team, opponent, sum(numerator) AS total FROM facts WHERE metric = 'net_price' GROUP BY 1, 2)
    SELECT team, opponent, round(total, 5) AS total, round(total / sum(total) OVER (PARTITION BY opponent), 6) AS share FROM shares""")
def share_of_total(spark, sf_dir):
    rows = aggregates.share_of_total(facts(spark, sf_dir, "net_price"), ["team"], ["opponent"], "numerator")
    return rounded(rounded(rows.select("team", "opponent", "total", "share"), "share"), "total", digits=5)


@query(f"""WITH {FACTS},
    shares AS (SELECT team, opponent, sum(numerator) AS total FROM facts WHERE metric = 'net_price' GROUP BY 1, 2),
    parts AS (SELECT team, opponent, total / sum(total) OVER (PARTITION BY opponent) AS share, team % 5 = 0 AS absent FROM shares),
    freed AS (SELECT opponent, sum(CASE WHEN absent THEN share ELSE 0 END) AS freed, sum(CASE WHEN absent THEN 0 ELSE share END) AS present FROM parts GROUP BY 1)
    SELECT team, opponent, round(share, 6) AS share, round(share + freed * share / nullif(present, 0), 6) AS new_share FROM parts JOIN freed USING (opponent) WHERE NOT absent""")
def share_redistribution(spark, sf_dir):
    """Shares of absent members go to the present ones in proportion; each group's total is conserved."""
    rows = aggregates.share_of_total(facts(spark, sf_dir, "net_price"), ["team"], ["opponent"], "numerator").withColumn("absent", F.col("team") % 5 == 0)
    group = Window.partitionBy("opponent")
    freed, present = F.sum(F.when(F.col("absent"), F.col("share")).otherwise(0.0)).over(group), F.sum(F.when(F.col("absent"), 0.0).otherwise(F.col("share"))).over(group)
    rows = rows.withColumn("new_share", F.col("share") + freed * F.col("share") / F.nullif(present, F.lit(0.0))).filter("NOT absent")
    return rounded(rows.select("team", "opponent", "share", "new_share"), "share", "new_share")
