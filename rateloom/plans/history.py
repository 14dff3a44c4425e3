"""Queries over an entity's own history: a customer's orders, a user's events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates, asof, rank, reshape
from ..shared import table
from .registry import big, query, rounded

LOG = """
    log AS (SELECT o_custkey, o_orderkey, o_totalprice AS x, year(o_orderdate) AS season, month(o_orderdate) AS week,
                   row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS ago
            FROM orders WHERE year(o_orderdate) < 2001 OR (year(o_orderdate) = 2001 AND month(o_orderdate) < 6)),
    weighted AS (SELECT *, power(0.8::DOUBLE, ago) * CASE WHEN season < 2001 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS w FROM log WHERE ago < 6)"""


def recent():
    return [F.desc("o_orderdate"), F.desc("o_orderkey")]


def season():
    return F.year("o_orderdate")


def week():
    return F.month("o_orderdate")


def history(spark, sf_dir):
    """A customer's last six orders before June 2001, most recent first, with recency weights."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("x"), "o_orderdate", season().alias("season"), week().alias("week"))
    rows = asof.last_n(orders.filter(asof.before("season", "week", 2001, 6)), ["o_custkey"], recent(), 6, "ago")
    return rows.withColumn("w", aggregates.recency_weight(F.col("ago"), F.col("season") < 2001))


@query("""SELECT o_custkey, o_orderkey, ago::BIGINT AS games_ago FROM (
    SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS ago FROM orders) WHERE ago < 8""")
def recent_n(spark, sf_dir):
    rows = asof.last_n(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], recent(), 8)
    return rows.select("o_custkey", "o_orderkey", big(F.col("games_ago")).alias("games_ago"))


@query("""SELECT o_custkey, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders
    WHERE year(o_orderdate) < 1998 OR (year(o_orderdate) = 1998 AND month(o_orderdate) < 7) GROUP BY 1""")
def asof_before(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", season().alias("season"), week().alias("week")).filter(asof.before("season", "week", 1998, 7))
    return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""WITH {LOG} SELECT o_custkey, round(sum(w * x) / sum(w), 4) AS w_mean, round(sum(w), 6) AS w_total, count(*)::BIGINT AS n, count(CASE WHEN season < 2001 THEN 1 END)::BIGINT AS n_prior
    FROM weighted GROUP BY 1 HAVING count(*) >= 3""")
def recency_weighted_mean(spark, sf_dir):
    """Baseline over the last six; fewer than three are not enough."""
    x, w = F.col("x"), F.col("w")
    rows = history(spark, sf_dir).groupBy("o_custkey").agg(F.round(F.sum(w * x) / F.sum(w), 4).alias("w_mean"), F.round(F.sum(w), 6).alias("w_total"), F.count(x).alias("n"), F.count(F.when(F.col("season") < 2001, 1)).alias("n_prior"))
    return rows.filter("n >= 3")


@query(f"""WITH {LOG}, s AS (SELECT o_custkey, sum(w) AS v1, sum(w * w) AS v2, sum(w * x / 1000) AS s1, sum(w * x * x / 1e6) AS s2 FROM weighted GROUP BY 1 HAVING count(*) >= 3)
    SELECT o_custkey, round(s1 / v1, 4) AS w_mean, round(greatest((s2 - s1 * s1 / v1) / (v1 - v2 / v1), 0.0), 2) AS w_variance, round(v1 * v1 / v2, 6) AS ess FROM s""")
def weighted_variance_ess(spark, sf_dir):
    """In thousands, which keeps the sums of squares exact enough."""
    moments = aggregates.weighted_moments(F.col("x") / 1000, F.col("w"))
    rows = history(spark, sf_dir).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in moments.items()]).filter("n >= 3")
    return rounded(rounded(rounded(rows.select("o_custkey", "w_mean", "w_variance", "ess"), "ess"), "w_mean", digits=4), "w_variance", digits=2)


@query("""SELECT user_id, event_id, count(value) OVER w AS n_prior, round(avg(value) OVER w, 6) AS prior_mean FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def prior_events_last4(spark, sf_dir):
    rows = asof.own_last_before(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), "user_id", ["ts", "event_id"], "value", 4)
    return rows.select("user_id", "event_id", big(F.col("n_prior")).alias("n_prior"), F.round("prior_mean", 6).alias("prior_mean"))


@query("""WITH spine AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
    ranked AS (SELECT s.event_id, s.user_id, f.value, row_number() OVER (PARTITION BY s.event_id ORDER BY f.ts DESC, f.event_id DESC) AS k
               FROM spine s LEFT JOIN events f ON f.user_id = s.user_id AND f.ts < s.ts AND f.event_type <> 'purchase')
    SELECT event_id, user_id, count(value)::BIGINT AS n_prior, round(avg(value), 5) AS prior_mean FROM ranked WHERE k <= 4 GROUP BY 1, 2""")
def prior_facts_of_spine(spark, sf_dir):
    """The last four facts of another kind strictly before each spine row, without an inequality join."""
    events = table(spark, sf_dir, "events")
    rows = asof.last_facts_before(events.filter("event_type = 'purchase'"), events.filter("event_type != 'purchase'"), "user_id", "ts", "value", 4, "event_id")
    return rows.select("event_id", "user_id", "n_prior", F.round("prior_mean", 5).alias("prior_mean"))


@query("""SELECT o_custkey, round(median(gap), 4) AS pace_days, count(gap)::BIGINT AS n FROM (
    SELECT o_custkey, date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate)::DOUBLE AS gap FROM orders)
    WHERE gap BETWEEN 1 AND 400 GROUP BY 1""")
def lag_pace_median(spark, sf_dir):
    before = F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.datediff("o_orderdate", before).cast("double").alias("gap")).filter("gap BETWEEN 1 AND 400")
    return rows.groupBy("o_custkey").agg(F.round(F.median("gap"), 4).alias("pace_days"), F.count("gap").alias("n"))


@query("""SELECT o_custkey, period, k::BIGINT AS k, round(sum(o_totalprice), 2) AS total FROM (
    SELECT o_custkey, (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS period, o_totalprice,
           dense_rank() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) * 12 + month(o_orderdate) DESC) AS k FROM orders) WHERE k <= 8 GROUP BY 1, 2, 3""")
def dense_rank_window(spark, sf_dir):
    """Totals of the last eight periods in which a customer was active."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", big(season() * 12 + week()).alias("period"), "o_totalprice").groupBy("o_custkey", "period").agg(F.sum("o_totalprice").alias("total"))
    rows = rows.withColumn("k", big(F.dense_rank().over(Window.partitionBy("o_custkey").orderBy(F.desc("period"))))).filter("k <= 8")
    return rounded(rows, "total", digits=2)


@query("""WITH p AS (SELECT o_custkey, (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS period, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
    SELECT o_custkey, period, round(CASE WHEN count(total) OVER w >= 2 THEN avg(total) OVER w END, 5) AS mean6 FROM p
    WINDOW w AS (PARTITION BY o_custkey ORDER BY period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""")
def trailing_mean_min(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey", big(season() * 12 + week()).alias("period")).agg(F.sum("o_totalprice").alias("total"))
    return rows.select("o_custkey", "period", F.round(asof.trailing_mean("total", asof.trailing(["o_custkey"], ["period"], 6), 2), 5).alias("mean6"))


@query("""SELECT o_custkey, round((max_by(o_totalprice, o_orderkey)), 2) AS last_by_key, round(max(o_totalprice), 2) AS longest, count(*)::BIGINT AS n FROM orders GROUP BY 1
    UNION ALL SELECT c_custkey, NULL, 0.0, 0 FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def longest_per_entity(spark, sf_dir):
    """The longest value of each entity; zero for entities without any."""
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", "o_orderkey").alias("last_by_key"), F.max("o_totalprice").alias("longest"), F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")).join(own, "o_custkey", "full")
    return rows.select("o_custkey", F.round("last_by_key", 2).alias("last_by_key"), F.round(F.coalesce("longest", F.lit(0.0)), 2).alias("longest"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("""WITH t AS (SELECT DISTINCT event_type FROM events)
    SELECT c_custkey AS user_id, event_type, coalesce(n, 0)::BIGINT AS n FROM customer CROSS JOIN t LEFT JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) e ON e.user_id = c_custkey AND e.event_type = t.event_type""".replace("SELECT c_custkey AS user_id, event_type,", "SELECT c_custkey AS user_id, t.event_type,"))
def zero_fill_missing(spark, sf_dir):
    """Every entity with every kind, zero where nothing was counted; the kinds, a handful, ride as an array."""
    events = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    kinds = events.agg(F.collect_set("event_type").alias("kinds"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")).join(F.broadcast(kinds)).select("user_id", F.explode("kinds").alias("event_type"))  # one row
    return users.join(events, ["user_id", "event_type"], "left").select("user_id", "event_type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("""SELECT c_mktsegment, o_custkey, round(total, 2) AS total, place::BIGINT AS place FROM (
    SELECT c_mktsegment, o_custkey, total, row_number() OVER (PARTITION BY c_mktsegment ORDER BY round(total, 2) DESC, o_custkey) AS place
    FROM (SELECT c_mktsegment, o_custkey, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)) WHERE place <= 10""")
def topk_board(spark, sf_dir):
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    rows = own.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return rank.top_k(rows, ["c_mktsegment"], [F.desc("total"), F.asc("o_custkey")], 10)


@query("""SELECT c_mktsegment, total AS upper_median FROM (
    SELECT c_mktsegment, round(total, 2) AS total, row_number() OVER (PARTITION BY c_mktsegment ORDER BY round(total, 2)) - 1 AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n
    FROM (SELECT c_mktsegment, o_custkey, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)) WHERE k = n // 2""")
def upper_median(spark, sf_dir):
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    rows = own.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return rank.upper_median(rows, ["c_mktsegment"], "total").withColumnRenamed("total", "upper_median")


@query("""SELECT user_id, max(CASE WHEN event_type = 'click' THEN total END) AS click, max(CASE WHEN event_type = 'purchase' THEN total END) AS purchase, max(CASE WHEN event_type = 'view' THEN total END) AS view
    FROM (SELECT user_id, event_type, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) GROUP BY 1""")
def eav_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("total"))
    return reshape.pivot_max(rows, ["user_id"], "event_type", "total", ["click", "purchase", "view"])


@query("""SELECT o_custkey, 'orders' AS metric, count(*)::DOUBLE AS value FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 'total', round(sum(o_totalprice), 2) FROM orders GROUP BY 1
    UNION ALL SELECT o_custkey, 'urgent', count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END)::DOUBLE FROM orders GROUP BY 1""")
def eav_unpivot(spark, sf_dir):
    """One scan and one aggregate, then rows."""
    wide = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).cast("double").alias("urgent"))
    return wide.unpivot(["o_custkey"], ["orders", "total", "urgent"], "metric", "value")
