"""What was known when: snapshots by calendar, dated reports, rates of reports, a weather effect, rates that age, scores by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates, asof, rank, versions
from ..shared import save, table
from . import projection
from .registry import big, query, rounded


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props").withColumn("day", F.to_date("ts"))


CHARTS = """
    days AS (SELECT *, ts::DATE AS day FROM events),
    charts AS (SELECT event_type, day AS charted, user_id, min(place)::BIGINT AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type, day ORDER BY value DESC, event_id) AS place FROM days WHERE (day(day) + length(event_type)) % 4 = 0) GROUP BY 1, 2, 3)"""


@query(f"""WITH {CHARTS},
    calendar AS (SELECT event_type, unnest(generate_series((SELECT min(day) FROM days), (SELECT max(day) FROM days), INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT event_type FROM days)),
    last AS (SELECT c.event_type, c.day, max(charted) AS charted FROM calendar c JOIN charts s ON s.event_type = c.event_type AND s.charted <= c.day GROUP BY 1, 2)
    SELECT event_type, day, charted, user_id, place FROM last JOIN charts USING (event_type, charted)""")
def snapshot_calendar(spark, sf_dir):
    """For every day and kind the last chart not after it, each user at the best of their places there.

    Charts come on some days only. The calendar and the chart days are stacked and the last one is carried forward over that
    small table; charts are then joined once, on their own day."""
    rows = events(spark, sf_dir)
    charted = rows.filter((F.dayofmonth("day") + F.length("event_type")) % 4 == 0)
    place = F.row_number().over(Window.partitionBy("event_type", "day").orderBy(F.desc("value"), "event_id"))
    charts = save(charted.withColumn("place", place).groupBy("event_type", "day", "user_id").agg(F.min("place").cast("long").alias("place")), "charts")
    span = rows.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    calendar = rows.select("event_type").distinct().crossJoin(F.broadcast(span)).select("event_type", F.explode(F.sequence("first", "last")).alias("day"))  # a single row
    marks = charts.select("event_type", F.col("day").alias("charted")).distinct()
    known = versions.as_of(calendar, marks, ["event_type"], "day", "charted")
    return known.join(charts.withColumnRenamed("day", "charted"), ["event_type", "charted"]).select("event_type", "day", "charted", "user_id", "place")


@query("""WITH days AS (SELECT *, ts::DATE AS day FROM events),
    reports AS (SELECT day, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY day, user_id ORDER BY ts DESC, event_id DESC) AS k FROM days WHERE event_type = 'signup' AND day(day) % 5 <> 0) WHERE k = 1),
    live AS (SELECT user_id, value, event_type AS source FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type <> 'error')::INT, ts DESC, event_id DESC) AS k FROM days WHERE event_type IN ('error', 'view')) WHERE k = 1),
    told AS (SELECT day, user_id, value, 'report' AS source FROM reports UNION ALL SELECT d.day, live.user_id, live.value, source FROM (SELECT DISTINCT day FROM days WHERE day NOT IN (SELECT day FROM reports)) d, live)
    SELECT day, user_id, CASE WHEN value > 60 THEN 'Out' WHEN value > 25 THEN 'Questionable' ELSE 'Full' END AS status, source FROM told""")
def dated_status(spark, sf_dir):
    """Each day's status of users: from that day's own reports where it has any, else from the live table, whose best source comes first."""
    rows = events(spark, sf_dir)
    reports = asof.first_by(rows.filter((F.col("event_type") == "signup") & (F.dayofmonth("day") % 5 != 0)), ["day", "user_id"], [F.desc("ts"), F.desc("event_id")]).select("day", "user_id", "value", F.lit("report").alias("source"))
    reports = save(reports, "reports")
    live = asof.first_by(rows.filter(F.col("event_type").isin("error", "view")), ["user_id"], [F.col("event_type") != "error", F.desc("ts"), F.desc("event_id")]).select("user_id", "value", F.col("event_type").alias("source"))
    # the days without a report ride on each live row as one array, as many as the calendar has
    bare = rows.select("day").distinct().join(reports.select("day").distinct(), "day", "left_anti").agg(F.collect_list("day").alias("days"))
    undated = live.crossJoin(F.broadcast(bare)).select(F.explode("days").alias("day"), "user_id", "value", "source")  # a single row
    status = F.when(F.col("value") > 60, "Out").when(F.col("value") > 25, "Questionable").otherwise("Full")
    return reports.unionByName(undated).select("day", "user_id", status.alias("status"), "source")


@query("""WITH days AS (SELECT *, ts::DATE AS day FROM events),
    spine AS (SELECT event_id, user_id, ts, day, CASE WHEN value > 60 THEN 'Out' WHEN value > 25 THEN 'Questionable' ELSE 'Full' END AS status, CASE WHEN k IS NULL THEN 'Unknown' WHEN k % 3 = 0 THEN 'Full' WHEN k % 3 = 1 THEN 'Limited' ELSE 'DNP' END AS practice
              FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM days WHERE event_type = 'signup')),
    facts AS (SELECT user_id, ts, event_id, least(1.0, value / 100) AS share FROM events WHERE event_type = 'purchase'),
    prior AS (SELECT s.event_id, avg(share) AS prior, count(share) AS n FROM (SELECT s.event_id, f.share, row_number() OVER (PARTITION BY s.event_id ORDER BY f.ts DESC, f.event_id DESC) AS k FROM spine s JOIN facts f ON f.user_id = s.user_id AND f.ts < s.ts) s WHERE k <= 4 GROUP BY 1),
    played AS (SELECT user_id, ts::DATE AS day, max(share) AS share FROM facts GROUP BY 1, 2),
    joined AS (SELECT status, practice, coalesce(c_mktsegment, 'UNK') AS segment, CASE WHEN coalesce(n, 0) = 0 THEN 'no_recent_games' WHEN prior >= 0.55 THEN 'starter' WHEN prior >= 0.2 THEN 'rotational' ELSE 'fringe' END AS role,
                      (played.share IS NOT NULL)::INT AS played, played.share, CASE WHEN prior > 0.05 AND played.share IS NOT NULL THEN least(played.share / prior, 1.5) END AS ratio
               FROM spine LEFT JOIN prior USING (event_id) LEFT JOIN played USING (user_id, day) LEFT JOIN customer ON c_custkey = user_id),
    cells AS (SELECT * FROM joined UNION ALL SELECT status, practice, 'ALL', role, played, share, ratio FROM joined)
    SELECT status, practice, role, segment, count(*)::BIGINT AS n, sum(played)::BIGINT AS n_played, round(avg(played), 6) AS p_played, round(avg(share), 6) AS mean_share, round(stddev_samp(share), 6) AS sd_share, round(avg(ratio), 6) AS mean_ratio FROM cells GROUP BY 1, 2, 3, 4""")
def report_rates(spark, sf_dir):
    """How often entities play, and how much, by what their dated report said and by their role, the mean of the last four facts
    strictly before the report; each cell by segment and over all segments. Means are taken to 12 digits first, so that a half of
    the sixth digit goes up in whatever order a cell was added."""
    rows = events(spark, sf_dir)
    k = F.get_json_object("props", "$.k").try_cast("long")
    practice = F.when(k.isNull(), "Unknown").when(k % 3 == 0, "Full").when(k % 3 == 1, "Limited").otherwise("DNP")
    status = F.when(F.col("value") > 60, "Out").when(F.col("value") > 25, "Questionable").otherwise("Full")
    spine = rows.filter("event_type = 'signup'").select("event_id", "user_id", "ts", "day", status.alias("status"), practice.alias("practice"))
    facts = rows.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", "day", F.least(F.lit(1.0), F.col("value") / 100).alias("share"))
    prior = asof.last_facts_before(spine.select("event_id", "user_id", "ts"), facts, "user_id", "ts", "share", 4, "event_id").select("event_id", "n_prior", "prior_mean")
    played = facts.groupBy("user_id", "day").agg(F.max("share").alias("share"))
    segments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    joined = spine.join(prior, "event_id", "left").join(played, ["user_id", "day"], "left").join(segments, "user_id", "left")
    own = F.col("prior_mean")
    role = F.when(F.coalesce("n_prior", F.lit(0)) == 0, "no_recent_games").when(own >= 0.55, "starter").when(own >= 0.2, "rotational").otherwise("fringe")
    ratio = F.when(own > 0.05, F.least(F.col("share") / own, F.when(F.col("share").isNotNull(), 1.5)))
    joined = joined.select("status", "practice", role.alias("role"), F.coalesce("segment", F.lit("UNK")).alias("segment"), F.col("share").isNotNull().cast("int").alias("played"), "share", ratio.alias("ratio"))
    cells = aggregates.with_marginal(joined, ["status", "practice", "role", "segment"], "segment", {
        "n": F.count(F.lit(1)), "n_played": F.sum("played").cast("long"), "p_played": F.avg("played"), "mean_share": F.avg("share"), "sd_share": F.stddev_samp("share"), "mean_ratio": F.avg("ratio")})
    means = ("p_played", "mean_share", "sd_share", "mean_ratio")
    return rounded(rounded(cells.select("status", "practice", "role", "segment", "n", "n_played", *means), *means, digits=12), *means)


#: The strongest wind that is modelled, games that identify a slope, and the bounds of its multiplier (fixed values).
MOST_WIND, LEAST_GAMES, LOW, HIGH = 25.0, 100, 0.75, 1.10
WINDS = (0, 10, 20, 40)


@query(f"""WITH games AS (SELECT c_mktsegment AS segment, o_orderkey, any_value(o_orderkey % 31)::DOUBLE AS wind, sum(l_extendedprice) / sum(l_quantity) AS rate, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
                          WHERE o_orderstatus <> 'F' GROUP BY 1, 2 HAVING sum(l_quantity) >= 10),
    sizes AS (SELECT segment, count(*)::BIGINT AS games FROM games GROUP BY 1),
    sums AS (SELECT segment, sum(w) AS w, sum(w * wind) / sum(w) AS mx, sum(w * rate) / sum(w) AS my, sum(w * wind * wind) / sum(w) AS xx, sum(w * wind * rate) / sum(w) AS xy FROM games WHERE wind <= 25 GROUP BY 1),
    fit AS (SELECT segment, games, my AS baseline, CASE WHEN games >= 100 THEN (xy - mx * my) / (xx - mx * mx) ELSE 0.0 END AS slope, mx, my FROM sums JOIN sizes USING (segment))
    SELECT segment, games, round(baseline, 4) AS baseline, round(slope, 5) AS per_unit, {", ".join(f"round(least(1.1, greatest(0.75, (my - slope * mx + slope * {min(x, 25)}) / baseline)), 6) AS at_{x}" for x in WINDS)} FROM fit""")
def weather_effect(spark, sf_dir):
    """What wind does to a segment's price of a unit in open games of ten units or more: a line weighted by volume over winds up to
    the strongest one modelled, flat below a hundred games; multipliers against the mean, held within bounds."""
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("rate"), F.sum("l_quantity").alias("w")).filter("w >= 10")
    games = lines.join(orders, "o_orderkey").withColumn("wind", (F.col("o_orderkey") % 31).cast("double"))
    x, y, w = F.col("wind"), F.col("rate"), F.when(F.col("wind") <= MOST_WIND, F.col("w"))
    total = F.sum(w)
    sums = games.groupBy("segment").agg(F.count(F.lit(1)).alias("games"), (F.sum(w * x) / total).alias("mx"), (F.sum(w * y) / total).alias("my"), (F.sum(w * x * x) / total).alias("xx"), (F.sum(w * x * y) / total).alias("xy")).filter("my IS NOT NULL")
    slope = F.when(F.col("games") >= LEAST_GAMES, (F.col("xy") - F.col("mx") * F.col("my")) / (F.col("xx") - F.col("mx") * F.col("mx"))).otherwise(0.0)
    fit = sums.withColumn("slope", slope)
    at = lambda wind: F.least(F.lit(HIGH), F.greatest(F.lit(LOW), (F.col("my") + F.col("slope") * (min(wind, MOST_WIND) - F.col("mx"))) / F.col("my")))
    return fit.select("segment", "games", F.round("my", 4).alias("baseline"), F.round("slope", 5).alias("per_unit"), *[F.round(at(x), 6).alias(f"at_{x}") for x in WINDS])


#: Months of a rate, and the prior's worth in games (fixed values).
RATE_MONTHS, PRIOR_GAMES = 10, 3.0
_W = "power(0.8, ago) * CASE WHEN season < last_season THEN 0.85 ELSE 1 END"


@query(f"""WITH {projection.MONTHS},
    league AS (SELECT segment, sum(urgent) / sum(n) AS prior FROM months GROUP BY 1),
    recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period DESC) - 1 AS ago, max(season) OVER (PARTITION BY entity) AS last_season FROM months) WHERE ago < 10),
    sums AS (SELECT entity, any_value(segment) AS segment, count(*)::BIGINT AS games, sum({_W} * urgent) AS wn, sum({_W} * n) AS wd, sum({_W}) AS wt FROM recent GROUP BY 1)
    SELECT entity, games, round(wn / wd, 6) AS own_rate, round((wn + prior * 3.0 * wd / wt) / (wd + 3.0 * wd / wt), 6) AS rate FROM sums JOIN league USING (segment)""")
def recency_rate(spark, sf_dir):
    """A rate as a ratio of recency-weighted sums, mixed with its position's by three games of the entity's own volume."""
    months = save(projection.months(spark, sf_dir), "months")
    prior = months.groupBy("segment").agg((F.sum("urgent") / F.sum("n")).alias("prior"))
    own = Window.partitionBy("entity")
    recent = months.withColumn("ago", F.row_number().over(own.orderBy(F.desc("period"))) - 1).withColumn("last_season", F.max("season").over(own)).filter(F.col("ago") < RATE_MONTHS)
    w = projection.recency()
    sums = recent.groupBy("entity").agg(F.min("segment").alias("segment"), F.count(F.lit(1)).alias("games"), F.sum(w * F.col("urgent")).alias("wn"), F.sum(w * F.col("n")).alias("wd"), F.sum(w).alias("wt"))
    weight = PRIOR_GAMES * F.col("wd") / F.col("wt")
    rows = sums.join(F.broadcast(prior), "segment")  # a row for each segment
    return rounded(rows.select("entity", "games", (F.col("wn") / F.col("wd")).alias("own_rate"), ((F.col("wn") + F.col("prior") * weight) / (F.col("wd") + weight)).alias("rate")), "own_rate", "rate")


#: How each position is ranked: score, tiebreaker, who is eligible (specification).
SCORES = {
    "AUTOMOBILE": ("orders * 1.13", "urgent", "true"),
    "BUILDING": ("orders + urgent", "share", "true"),
    "FURNITURE": ("orders * least(1.0, greatest(0.1, share * 20))", "urgent", "true"),
    "HOUSEHOLD": ("value", "orders", "n_games >= 2"),
    "MACHINERY": ("share * urgent", "share", "share >= 0.01"),
}
_FORMULA = [f"CASE {' '.join(f'WHEN segment = {chr(39)}{s}{chr(39)} THEN {f[i]}' for s, f in SCORES.items())} END" for i in range(3)]


@query(f"""WITH {projection.MONTHS},
    own AS (SELECT entity, any_value(team) AS team, any_value(segment) AS segment, count(*)::BIGINT AS n_games, sum({_W} * n * n) / sum({_W} * n) AS orders, sum({_W} * n * urgent) / sum({_W} * n) AS urgent, sum({_W} * n * value) / sum({_W} * n) AS value, sum({_W} * n * share) / sum({_W} * n) AS share FROM latest GROUP BY 1),
    scored AS (SELECT entity, team, segment, n_games, round(({_FORMULA[0]})::DOUBLE, 6) AS score, round(({_FORMULA[1]})::DOUBLE, 6) AS tiebreaker FROM own WHERE {_FORMULA[2]})
    SELECT *, (row_number() OVER (PARTITION BY segment ORDER BY score DESC, tiebreaker DESC, entity))::BIGINT AS place FROM scored QUALIFY place <= 10""")
def position_scores(spark, sf_dir):
    """The ten best of each position, each ranked by a formula, a tiebreaker and an eligibility of its own, over recency-weighted volumes."""
    rows = projection.latest(spark, sf_dir)
    w = projection.recency() * F.col("n")
    mean = lambda x: (F.sum(w * F.col(x)) / F.sum(w)).alias(x if x != "n" else "orders")
    own = rows.groupBy("entity").agg(F.min("team").alias("team"), F.min("segment").alias("segment"), F.count(F.lit(1)).alias("n_games"), *[mean(x) for x in ("n", "urgent", "value", "share")])
    scored = own.filter(_FORMULA[2]).select("entity", "team", "segment", "n_games", F.round(F.expr(_FORMULA[0]).cast("double"), 6).alias("score"), F.round(F.expr(_FORMULA[1]).cast("double"), 6).alias("tiebreaker"))
    return rank.top_k(scored, ["segment"], [F.desc("score"), F.desc("tiebreaker"), F.asc("entity")], 10)
