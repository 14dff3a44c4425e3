"""Queries over the event stream's table: snapshots, differences, marginals, fallbacks, JSON, windows, correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import aggregates, asof
from ..shared import table
from .registry import big, query, rounded


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_snapshot(spark, sf_dir):
    """The latest row of each entity: an aggregate on (time, id), so nothing is sorted."""
    last = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id"))
    return events(spark, sf_dir).groupBy("user_id").agg(last.alias("last")).select("user_id", "last.*")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def source_priority_pick(spark, sf_dir):
    """Of several sources the best, then the latest."""
    best = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    return asof.first_by(events(spark, sf_dir), ["user_id"], [best.asc(), F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""WITH old AS (SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE ts < TIMESTAMP '2024-01-16') WHERE k = 1),
    new AS (SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1),
    c AS (SELECT user_id, 'event_type' AS field, o.event_type AS old_value, n.event_type AS new_value FROM old o JOIN new n USING (user_id) WHERE o.event_type IS DISTINCT FROM n.event_type
          UNION ALL SELECT user_id, 'sign', CASE WHEN o.value > 50 THEN 'high' ELSE 'low' END, CASE WHEN n.value > 50 THEN 'high' ELSE 'low' END FROM old o JOIN new n USING (user_id) WHERE (o.value > 50) <> (n.value > 50))
    SELECT *, md5(concat_ws('|', user_id::VARCHAR, field, old_value, new_value)) AS change_id FROM c""")
def snapshot_diff(spark, sf_dir):
    """What changed between two snapshots, a row for each field, with an idempotent key."""
    rows = events(spark, sf_dir)
    last = lambda df: df.groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.event_type", F.when(F.col("x.value") > 50, "high").otherwise("low").alias("sign"))
    return asof.snapshot_diff(last(rows.filter("ts < TIMESTAMP_NTZ '2024-01-16'")), last(rows), "user_id", ["event_type", "sign"])


@query("""WITH e AS (SELECT event_type, c_mktsegment AS segment, value FROM events JOIN customer ON user_id = c_custkey)
    SELECT event_type, segment, count(*)::BIGINT AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM e GROUP BY 1, 2
    UNION ALL SELECT event_type, 'ALL', count(*), round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) FROM e GROUP BY 1""")
def position_marginals(spark, sf_dir):
    """Cells and their marginal in one pass of grouping sets."""
    rows = events(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment")), "user_id")
    rate = F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0))
    return rounded(aggregates.with_marginal(rows, ["event_type", "segment"], "segment", {"n": F.count(F.lit(1)), "rate": rate}), "rate")


@query("""WITH e AS (SELECT event_id, event_type, c_mktsegment AS segment, user_id, value > 50 AS hit FROM events JOIN customer ON user_id = c_custkey),
    l1 AS (SELECT event_type, user_id, count(*) AS n, avg(hit::INT) AS r FROM e GROUP BY 1, 2), l2 AS (SELECT event_type, segment, count(*) AS n, avg(hit::INT) AS r FROM e GROUP BY 1, 2), l3 AS (SELECT event_type, count(*) AS n, avg(hit::INT) AS r FROM e GROUP BY 1)
    SELECT event_id, round(coalesce(CASE WHEN l1.n >= 20 THEN l1.r END, CASE WHEN l2.n >= 30 THEN l2.r END, CASE WHEN l3.n >= 30 THEN l3.r END, 0.5), 6) AS rate,
           CASE WHEN l1.n >= 20 THEN 'entity' WHEN l2.n >= 30 THEN 'segment' WHEN l3.n >= 30 THEN 'kind' ELSE 'constant' END AS level
    FROM e LEFT JOIN l1 USING (event_type, user_id) LEFT JOIN l2 USING (event_type, segment) LEFT JOIN l3 USING (event_type)""")
def hierarchical_fallback(spark, sf_dir):
    """The rate of the narrowest cell with enough rows, else of a wider one, else a constant."""
    rows = events(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment")), "user_id")
    hit = F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0))
    levels = [("entity", ["event_type", "user_id"], 20), ("segment", ["event_type", "segment"], 30), ("kind", ["event_type"], 30)]
    out, rate, level = rows, [], F.lit("constant")
    for name, key, least in levels:
        out = out.join(rows.groupBy(*key).agg(F.count(F.lit(1)).alias(f"n_{name}"), hit.alias(f"r_{name}")), key, "left")
        rate.append(F.when(F.col(f"n_{name}") >= least, F.col(f"r_{name}")))
    for name, _, least in reversed(levels):
        level = F.when(F.col(f"n_{name}") >= least, F.lit(name)).otherwise(level)
    return out.select("event_id", F.round(F.coalesce(*rate, F.lit(0.5)), 6).alias("rate"), level.alias("level"))


@query("SELECT event_type, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total_k, max(json_extract(props, '$.k')::BIGINT) AS max_k, count(*)::BIGINT AS n FROM events GROUP BY 1")
def json_extract_agg(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return events(spark, sf_dir).groupBy("event_type").agg(F.sum(k).alias("total_k"), F.max(k).alias("max_k"), F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT date_trunc('day', ts)::DATE AS day, event_type, sum(value) AS v FROM events GROUP BY 1, 2)
    SELECT x.event_type AS a, y.event_type AS b, round(corr(x.v, y.v), 4) AS r, count(*)::BIGINT AS n FROM d x JOIN d y USING (day) WHERE x.event_type < y.event_type GROUP BY 1, 2 HAVING abs(corr(x.v, y.v)) >= 0.03""")
def pair_correlation(spark, sf_dir):
    daily = events(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.sum("value").alias("v"))
    return rounded(aggregates.pair_correlation(daily, "day", "event_type", "v", 0.03), "r", digits=4)


@query("""WITH u AS (SELECT user_id, date_trunc('day', ts)::DATE AS day, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS a, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS b, max(CASE WHEN value > 80 THEN 1 ELSE 0 END) AS c FROM events GROUP BY 1, 2)
    SELECT round(avg(CASE WHEN a + b + c = 3 THEN 1.0 ELSE 0.0 END), 6) AS joint, round(avg(a) * avg(b) * avg(c), 6) AS independent, round(avg(CASE WHEN a + b + c = 3 THEN 1.0 ELSE 0.0 END) / (avg(a) * avg(b) * avg(c)), 4) AS lift FROM u""")
def joint_vs_independent(spark, sf_dir):
    has = lambda c: F.max(F.when(c, 1).otherwise(0))
    days = events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(has(F.col("event_type") == "click").alias("a"), has(F.col("event_type") == "purchase").alias("b"), has(F.col("value") > 80).alias("c"))
    out = days.agg(*[c.alias(k) for k, c in aggregates.joint_vs_independent(days, "abc").items()])
    return rounded(rounded(out, "joint", "independent"), "lift", digits=4)


@query("""WITH c AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'click'), p AS (SELECT event_id AS p_id, user_id, ts AS p_ts, value AS p_value FROM events WHERE event_type = 'view'),
    j AS (SELECT event_id, p_id, abs(epoch_us(ts) - epoch_us(p_ts)) AS apart_us, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(ts) - epoch_us(p_ts)), p_value DESC, p_id) AS k FROM c JOIN p USING (user_id) WHERE abs(epoch_us(ts) - epoch_us(p_ts)) <= 43200000000)
    SELECT event_id, p_id, apart_us::BIGINT AS apart_us FROM j WHERE k = 1""")
def nearest_time_match(spark, sf_dir):
    clicks = events(spark, sf_dir).filter("event_type = 'click'").select("event_id", "user_id", "ts")
    views = events(spark, sf_dir).filter("event_type = 'view'").select(F.col("event_id").alias("p_id"), "user_id", F.col("ts").alias("p_ts"), F.col("value").alias("p_value"))
    return asof.nearest(clicks, views, "user_id", "ts", "p_ts", "event_id", "p_id", 43_200, "p_value").select("event_id", "p_id", "apart_us")


@query("""SELECT event_type, CASE WHEN age < 24 THEN 'green' WHEN age < 72 THEN 'yellow' ELSE 'red' END AS badge, count(*)::BIGINT AS n
    FROM (SELECT event_type, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 3600000000.0 AS age FROM events) GROUP BY 1, 2""")
def freshness_badges(spark, sf_dir):
    age = (F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9
    return events(spark, sf_dir).groupBy("event_type", scalar.freshness(age, 24, 72).alias("badge")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""SELECT start, count(*)::BIGINT AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1""")
def sliding_window(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, session""")
def session_window(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n")


@query("""WITH u AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT event_type, n AS value, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY event_type) AS prob FROM u GROUP BY 1, 2),
    a AS (SELECT value, prob FROM p WHERE event_type = 'click'), b AS (SELECT value, prob FROM p WHERE event_type = 'purchase')
    SELECT (3 * a.value + b.value)::BIGINT AS value, round(sum(a.prob * b.prob), 8) AS prob FROM a CROSS JOIN b GROUP BY 1""")
def convolve_sum(spark, sf_dir):
    """Distribution of 3 A + B from two small supports; the smaller support rides as one array."""
    counts = events(spark, sf_dir).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("value"))
    supports = counts.filter("event_type IN ('click', 'purchase')").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("n"))
    whole = supports.groupBy("event_type").agg(F.sum("n").alias("total"))
    supports = supports.join(F.broadcast(whole), "event_type").select("event_type", "value", (F.col("n") / F.col("total")).alias("prob"))
    b = supports.filter("event_type = 'purchase'").agg(F.collect_list(F.struct(F.col("value").alias("v"), F.col("prob").alias("p"))).alias("b"))
    rows = supports.filter("event_type = 'click'").join(F.broadcast(b)).select("value", "prob", F.explode("b").alias("b"))  # one row
    return rounded(rows.groupBy(big(3 * F.col("value") + F.col("b.v")).alias("value")).agg(F.sum(F.col("prob") * F.col("b.p")).alias("prob")), "prob", digits=8)
