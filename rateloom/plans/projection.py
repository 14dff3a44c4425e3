"""Usage, priors, absences, rankings, fitted environments, projections and their walk-forward replay.

An order is a game, a customer an entity, a market segment its position, a nation its team, a month the period and a
year the season. What a row may know stands strictly before it: history is a window over (entity, period), never a join of
periods with periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import laws
from ..operators import aggregates, events_fit, rank
from ..shared import save, table
from .registry import big, query, rounded

DECAY, DISCOUNT, RECENT = 0.8, 0.85, 6

GAMES = """
    games AS (SELECT o_orderkey, o_custkey AS entity, c_nationkey::BIGINT AS team, c_mktsegment AS segment, year(o_orderdate)::BIGINT AS season,
                     (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS period, o_totalprice / 1000 AS value, (o_orderpriority = '1-URGENT')::INT AS urgent
              FROM orders JOIN customer ON o_custkey = c_custkey)"""
MONTHS = GAMES + """,
    months AS (SELECT entity, team, segment, season, period, count(*)::BIGINT AS n, sum(value) AS value, sum(urgent)::DOUBLE AS urgent FROM games GROUP BY ALL),
    teams AS (SELECT team, period, sum(value) AS team_value FROM months GROUP BY 1, 2),
    shares AS (SELECT months.*, value / team_value AS share FROM months JOIN teams USING (team, period)),
    latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period DESC) - 1 AS ago, max(season) OVER (PARTITION BY entity) AS last_season FROM shares) WHERE ago < 6)"""


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("entity"), "o_orderdate", "o_totalprice", "o_orderpriority")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), big(F.col("c_nationkey")).alias("team"), F.col("c_mktsegment").alias("segment"))
    return orders.join(people, "entity").select(
        "o_orderkey", "entity", "team", "segment", big(F.year("o_orderdate")).alias("season"), big(F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("period"),
        (F.col("o_totalprice") / 1000).alias("value"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"), (F.col("o_orderpriority") == "2-HIGH").cast("int").alias("high"))


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return games(spark, sf_dir).groupBy("entity", "team", "segment", "season", "period").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"), F.sum("urgent").cast("double").alias("urgent"))


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months with the entity's share of its team's value; the teams' totals are a second small aggregate of the first."""
    rows = months(spark, sf_dir)
    totals = rows.groupBy("team", "period").agg(F.sum("value").alias("team_value"))
    return rows.join(totals, ["team", "period"]).withColumn("share", F.col("value") / F.col("team_value"))


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ``RECENT`` months of every entity, 0 ago first."""
    own = Window.partitionBy("entity")
    rows = shares(spark, sf_dir).withColumn("ago", F.row_number().over(own.orderBy(F.desc("period"))) - 1)
    return rows.withColumn("last_season", F.max("season").over(own)).filter(F.col("ago") < RECENT)


def recency() -> Column:
    return aggregates.recency_weight(F.col("ago"), F.col("season") < F.col("last_season"), DECAY, DISCOUNT)


WEIGHT = "pow(0.8, ago) * CASE WHEN season < last_season THEN 0.85 ELSE 1 END"
USAGE = MONTHS + f""",
    usage AS (SELECT entity, any_value(team) AS team, any_value(segment) AS segment, count(*)::BIGINT AS n_games, sum({WEIGHT} * n * share) / sum({WEIGHT} * n) AS share,
                     sum({WEIGHT} * value) / sum({WEIGHT}) AS mean, sum({WEIGHT}) * sum({WEIGHT}) / sum({WEIGHT} * {WEIGHT}) AS n_eff,
                     sum({WEIGHT} * value * value) / sum({WEIGHT}) - (sum({WEIGHT} * value) / sum({WEIGHT})) ** 2 AS variance
              FROM latest GROUP BY entity)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entity: share weighted by games and recency; mean, variance and effective size of its months' values."""
    w = recency()
    s = lambda x: F.sum(w * x)
    return latest(spark, sf_dir).groupBy("entity").agg(
        F.min("team").alias("team"), F.min("segment").alias("segment"), F.count(F.lit(1)).alias("n_games"), (s(F.col("n") * F.col("share")) / s(F.col("n"))).alias("share"),
        (s(F.col("value")) / F.sum(w)).alias("mean"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("n_eff"),
        (s(F.col("value") * F.col("value")) / F.sum(w) - F.pow(s(F.col("value")) / F.sum(w), 2)).alias("variance"))


@query(f"WITH {USAGE} SELECT entity, team, n_games, round(share, 6) AS share, round(n_eff, 5) AS n_eff FROM usage")
def usage_share(spark, sf_dir):
    return rounded(rounded(usage(spark, sf_dir).select("entity", "team", "n_games", "share", "n_eff"), "share"), "n_eff", digits=5)


PRIORS = USAGE + """,
    priors AS (SELECT segment, avg(value) AS prior_mean, var_pop(value) AS prior_variance FROM months GROUP BY 1),
    blended AS (SELECT entity, team, segment, n_games, share, mean AS own_mean, variance AS own_variance, prior_mean, prior_variance, n_eff / (n_eff + 3) AS w,
                       n_eff / (n_eff + 3) * mean + (1 - n_eff / (n_eff + 3)) * prior_mean AS mean
                FROM usage JOIN priors USING (segment)),
    blend AS (SELECT *, w * own_variance + (1 - w) * prior_variance + w * (own_mean - mean) ** 2 + (1 - w) * (prior_mean - mean) ** 2 AS variance FROM blended)"""


def blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own moments and the segment's prior, which counts as three games; the spread between the two means stays in the variance."""
    prior = months(spark, sf_dir).groupBy("segment").agg(F.avg("value").alias("prior_mean"), F.var_pop("value").alias("prior_variance"))
    rows = usage(spark, sf_dir).withColumnsRenamed({"mean": "own_mean", "variance": "own_variance"}).join(F.broadcast(prior), "segment")  # a row for each segment
    w = F.col("n_eff") / (F.col("n_eff") + 3)
    rows = rows.withColumn("w", w).withColumn("mean", F.col("w") * F.col("own_mean") + (1 - F.col("w")) * F.col("prior_mean"))
    within = F.col("w") * F.col("own_variance") + (1 - F.col("w")) * F.col("prior_variance")
    between = F.col("w") * F.pow(F.col("own_mean") - F.col("mean"), 2) + (1 - F.col("w")) * F.pow(F.col("prior_mean") - F.col("mean"), 2)
    return rows.withColumn("variance", within + between)


@query(f"WITH {PRIORS} SELECT entity, segment, round(w, 6) AS w, round(mean, 4) AS mean, round(variance, 2) AS variance FROM blend")
def prior_blend(spark, sf_dir):
    return rounded(rounded(rounded(blend(spark, sf_dir).select("entity", "segment", "w", "mean", "variance"), "w"), "mean", digits=4), "variance", digits=2)


#: Entities that are ruled out, and how an absent share is dealt to the others' segments (fixed values).
RULED_OUT = "c_acctbal < -500"
SPLIT = (("BUILDING", 0.60), ("MACHINERY", 0.25), ("FURNITURE", 0.15))
ABSENCES = MONTHS + f""",
    cutoffs AS (SELECT team, min(period) AS cutoff FROM (SELECT team, period, row_number() OVER (PARTITION BY team ORDER BY period DESC) AS r FROM teams) WHERE r <= 6 GROUP BY 1),
    recent AS (SELECT entity, team, segment, avg(share) AS share, max(period) AS last_seen FROM latest GROUP BY ALL),
    states AS (SELECT recent.*, cutoff, {RULED_OUT} AS ruled_out FROM recent JOIN cutoffs USING (team) JOIN customer ON entity = c_custkey),
    absent AS (SELECT * FROM states WHERE ruled_out AND share > 0.001 AND last_seen >= cutoff),
    healthy AS (SELECT * FROM states WHERE NOT ruled_out)"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity's mean share of its last months, when it was last seen, its team's sixth-last period, and whether it is ruled out."""
    rows = save(latest(spark, sf_dir), "latest-months")
    newest = months(spark, sf_dir).select("team", "period").distinct()
    place = F.row_number().over(Window.partitionBy("team").orderBy(F.desc("period")))
    cutoffs = newest.withColumn("r", place).filter(F.col("r") <= RECENT).groupBy("team").agg(F.min("period").alias("cutoff"))
    recent = rows.groupBy("entity", "team", "segment").agg(F.avg("share").alias("share"), F.max("period").alias("last_seen"))
    out = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.expr(RULED_OUT).alias("ruled_out"))
    return recent.join(cutoffs, "team").join(out, "entity")


def absences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(absent, healthy). Who was gone before the team's window is already in the others' shares."""
    rows = save(states(spark, sf_dir), "states")
    return rows.filter("ruled_out AND share > 0.001 AND last_seen >= cutoff"), rows.filter("NOT ruled_out")


@query(f"""WITH {ABSENCES} SELECT entity, team, segment, round(share, 6) AS share, 'absent' AS state FROM absent
    UNION ALL SELECT entity, team, segment, round(share, 6), 'healthy' FROM healthy""")
def absent_and_healthy(spark, sf_dir):
    absent, healthy = absences(spark, sf_dir)
    both = absent.withColumn("state", F.lit("absent")).unionByName(healthy.withColumn("state", F.lit("healthy")))
    return rounded(both.select("entity", "team", "segment", "share", "state"), "share")


_PART = "CASE segment " + " ".join(f"WHEN '{s}' THEN {p}" for s, p in SPLIT) + " ELSE 0.0 END"


@query(f"""WITH {ABSENCES},
    lost AS (SELECT team, sum(share) AS lost FROM absent GROUP BY 1),
    slices AS (SELECT team, segment, sum(share) AS slice, count(*) AS peers, {_PART} AS part FROM healthy GROUP BY ALL),
    whole AS (SELECT team, sum(slice) AS whole, sum(part) AS dealt FROM slices GROUP BY 1)
    SELECT entity, team, segment, round(share, 6) AS share,
           round(share + lost * (part * CASE WHEN slice > 0 THEN share / slice ELSE 1.0 / peers END + (1 - dealt) * CASE WHEN whole > 0 THEN share / whole ELSE 0 END), 6) AS new_share
    FROM healthy JOIN lost USING (team) JOIN slices USING (team, segment) JOIN whole USING (team)""")
def absent_share_dealt(spark, sf_dir):
    """A team's absent share goes to three segments by a fixed split, inside each by the healthy peers' shares; parts of segments
    that the team has not are dealt over all its healthy entities."""
    absent, healthy = absences(spark, sf_dir)
    lost = absent.groupBy("team").agg(F.sum("share").alias("lost"))
    slices = healthy.groupBy("team", "segment").agg(F.sum("share").alias("slice"), F.count(F.lit(1)).alias("peers")).withColumn("part", F.expr(_PART).cast("double"))
    slices = save(slices, "slices")
    whole = slices.groupBy("team").agg(F.sum("slice").alias("whole"), F.sum("part").alias("dealt"))
    small = slices.join(whole, "team").join(lost, "team")  # a row for each team and segment
    rows = healthy.join(F.broadcast(small), ["team", "segment"])
    inside = F.when(F.col("slice") > 0, F.col("share") / F.col("slice")).otherwise(1 / F.col("peers"))
    over = F.when(F.col("whole") > 0, F.col("share") / F.col("whole")).otherwise(0.0)
    gained = F.col("lost") * (F.col("part") * inside + (1 - F.col("dealt")) * over)
    return rounded(rows.select("entity", "team", "segment", "share", (F.col("share") + gained).alias("new_share")), "share", "new_share")


RANKS = USAGE + """,
    factors AS (SELECT team, avg(team_value) / (SELECT avg(team_value) FROM teams) AS factor FROM teams GROUP BY 1),
    scored AS (SELECT entity, segment, n_games, mean * factor AS score FROM usage JOIN factors USING (team)),
    middles AS (SELECT segment, list_sort(list(score))[(count(*) // 2 + 1)::BIGINT] AS middle FROM scored GROUP BY 1),
    final AS (SELECT entity, segment, n_games, round(n_games / (n_games + 2.0) * score + 2.0 / (n_games + 2.0) * middle, 6) AS score FROM scored JOIN middles USING (segment))"""


@query(f"WITH {RANKS} SELECT *, (rank() OVER (PARTITION BY segment ORDER BY score DESC))::BIGINT AS place FROM final QUALIFY place <= 50")
def ranking_score(spark, sf_dir):
    """The fifty best of each segment: an entity's mean times its team's factor, shrunk to the segment's upper median by n / (n + 2)."""
    teams = months(spark, sf_dir).groupBy("team", "period").agg(F.sum("value").alias("team_value"))
    league = teams.agg(F.avg("team_value").alias("league"))
    factors = teams.groupBy("team").agg(F.avg("team_value").alias("own")).crossJoin(F.broadcast(league)).select("team", (F.col("own") / F.col("league")).alias("factor"))  # a single row
    scored = save(usage(spark, sf_dir).join(F.broadcast(factors), "team").select("entity", "segment", "n_games", (F.col("mean") * F.col("factor")).alias("score")), "scored")  # a row for each team
    middles = rank.upper_median(scored, ["segment"], "score").withColumnRenamed("score", "middle")
    score = rank.shrink_to_median(F.col("n_games"), F.col("score"), F.col("middle"))
    rows = scored.join(F.broadcast(middles), "segment").select("entity", "segment", "n_games", F.round(score, 6).alias("score"))  # a row for each segment
    place = F.rank().over(Window.partitionBy("segment").orderBy(F.desc("score")))
    return rows.withColumn("place", big(place)).filter("place <= 50")


@query(f"""WITH {GAMES}, seasons AS (SELECT team, season, min(segment) AS coach, avg(urgent) AS rate FROM games WHERE (entity + season) % 7 = team % 7 GROUP BY 1, 2)
    SELECT a.team, a.season, a.coach, b.coach AS prior_coach, coalesce(a.coach <> b.coach, false) AS changed, round(coalesce(a.rate - b.rate, 0), 6) AS shift
    FROM seasons a LEFT JOIN seasons b ON a.team = b.team AND a.season = b.season + 1""")
def continuity(spark, sf_dir):
    """A team's season against the one before: who leads it, and how its rate moved."""
    own = games(spark, sf_dir).filter((F.col("entity") + F.col("season")) % 7 == F.col("team") % 7)
    seasons = save(own.groupBy("team", "season").agg(F.min("segment").alias("coach"), F.avg("urgent").alias("rate")), "seasons")
    before = seasons.select("team", (F.col("season") + 1).alias("season"), F.col("coach").alias("prior_coach"), F.col("rate").alias("prior_rate"))
    rows = seasons.join(before, ["team", "season"], "left")
    shift = F.coalesce(F.col("rate") - F.col("prior_rate"), F.lit(0.0))
    return rows.select("team", "season", "coach", "prior_coach", F.coalesce(F.col("coach") != F.col("prior_coach"), F.lit(False)).alias("changed"), F.round(shift, 6).alias("shift"))


FEATURES = MONTHS + """,
    features AS (SELECT entity, segment, period, n, urgent, count(*) OVER w AS seen, sum(urgent) OVER w / greatest(sum(n) OVER w, 1e-9) AS ratio, avg(share) OVER w AS usage
                 FROM shares WINDOW w AS (PARTITION BY entity ORDER BY period ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))"""


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every month with the ratio and the mean share of the ten months before it, where there are three or more; fits and projections read the same window."""
    before = Window.partitionBy("entity").orderBy("period").rowsBetween(-10, -1)
    ratio = F.sum("urgent").over(before) / F.greatest(F.sum("n").over(before).cast("double"), F.lit(1e-9))
    rows = shares(spark, sf_dir).select("entity", "segment", "period", "n", "urgent", F.count(F.lit(1)).over(before).alias("seen"), ratio.alias("ratio"), F.avg("share").over(before).alias("usage"))
    return rows.filter("seen >= 3")


@query(f"WITH {FEATURES} SELECT entity, period, round(ratio, 6) AS ratio, round(usage, 6) AS usage FROM features WHERE seen >= 3")
def trailing_event_features(spark, sf_dir):
    return rounded(event_features(spark, sf_dir).select("entity", "period", "ratio", "usage"), "ratio", "usage")


TWO_PART = GAMES + """,
    two AS (SELECT entity, team, segment, period, count(*)::DOUBLE AS n, sum(value) AS value, sum(urgent)::DOUBLE AS urgent, sum((o_orderpriority = '2-HIGH')::INT)::DOUBLE AS high FROM games JOIN orders USING (o_orderkey) GROUP BY ALL),
    sides AS (SELECT team, period, sum(n) AS team_n, sum(value) AS team_value, sum(urgent) AS team_urgent, sum(high) AS team_high FROM two GROUP BY 1, 2),
    league AS (SELECT avg(team_urgent) AS a, avg(team_high) AS b FROM sides),
    history AS (SELECT segment, (urgent + high > 0)::INT AS y, count(*) OVER w AS seen, avg(n / team_n) OVER w AS x1, sum(urgent) OVER w / greatest(sum(team_urgent) OVER w, 1e-9) AS x2, avg(value / team_value) OVER w AS x3, sum(high) OVER w / greatest(sum(team_high) OVER w, 1e-9) AS x4
                FROM two JOIN sides USING (team, period) WINDOW w AS (PARTITION BY entity ORDER BY period ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
    training AS (SELECT segment, y, a, b, x1, x2, x3, x4, greatest(x3, 0.02) AS w FROM history, league WHERE seen >= 3)"""


def two_part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every month of an entity with three or more of its last ten months: two kinds of events, the shares and the ratios before, weighted by usage."""
    two = save(games(spark, sf_dir).groupBy("entity", "team", "segment", "period").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("value").alias("value"), F.sum("urgent").cast("double").alias("urgent"), F.sum("high").cast("double").alias("high")), "two-kinds")
    sides = save(two.groupBy("team", "period").agg(*[F.sum(c).alias(f"team_{c}") for c in ("n", "value", "urgent", "high")]), "team-kinds")
    league = sides.agg(F.avg("team_urgent").alias("a"), F.avg("team_high").alias("b"))
    w = Window.partitionBy("entity").orderBy("period").rowsBetween(-10, -1)
    ratio = lambda x: F.sum(x).over(w) / F.greatest(F.sum(f"team_{x}").over(w), F.lit(1e-9))
    met = two.join(sides, ["team", "period"]).select(
        "segment", (F.col("urgent") + F.col("high") > 0).cast("int").alias("y"), F.count(F.lit(1)).over(w).alias("seen"), F.avg(F.col("n") / F.col("team_n")).over(w).alias("x1"), ratio("urgent").alias("x2"), F.avg(F.col("value") / F.col("team_value")).over(w).alias("x3"), ratio("high").alias("x4"))
    return met.filter("seen >= 3").withColumn("w", F.greatest("x3", F.lit(0.02))).crossJoin(F.broadcast(league)).drop("seen")  # a single row


_CHANCE = "least(1 - 1e-4, greatest(1e-4, 1 - exp(-(a * greatest(0, {0}0 + {0}1 * x1 + {0}2 * x2) + b * greatest(0, {0}3 + {0}4 * x3 + {0}5 * x4)))))"
_DIRECTIONS = ("1", "x1", "x2", "1", "x3", "x4")
#: Accelerated projected gradient with a step of its own for each coefficient, 600 times.
EVENT_FIT_SQL = f"""WITH RECURSIVE {TWO_PART},
    scales AS (SELECT segment, count(*)::BIGINT AS n, sum(w * y) / sum(w) AS rate, {", ".join(f"0.2 / (sum(w * power({'a' if i < 3 else 'b'} * {x}, 2) * (1 - p) / p) / sum(w)) AS s{i}" for i, x in enumerate(_DIRECTIONS))}
               FROM (SELECT *, {_CHANCE.replace("{0}0", "0.0").replace("{0}1", "0.4").replace("{0}2", "0.4").replace("{0}3", "0.0").replace("{0}4", "0.4").replace("{0}5", "0.4")} AS p FROM training) GROUP BY 1),
    starts AS (SELECT * FROM (VALUES {", ".join(f"({k}, {', '.join(f'{v}::DOUBLE' for v in start.tolist())})" for k, start in enumerate(events_fit.STARTS))}) AS v(s, {", ".join(f"t{i}" for i in range(6))})),
    it AS (SELECT 0 AS k, segment, s, {", ".join(f"t{i}, t{i} AS z{i}" for i in range(6))} FROM scales, starts
        UNION ALL
        SELECT k + 1, segment, s, {", ".join(f"n{i}, n{i} + k / (k + 3.0) * (n{i} - t{i})" for i in range(6))} FROM (
            SELECT k, segment, s, {", ".join(f"t{i}" for i in range(6))}, {", ".join(f"least({'0.5' if i % 3 == 0 else '3.0'}, greatest({'-0.5' if i % 3 == 0 else '0.0'}, z{i} - any_value(s{i}) * sum(w * slope * {'one' if i < 3 else 'two'} * {x}) / sum(w))) AS n{i}" for i, x in enumerate(_DIRECTIONS))}
            FROM (SELECT *, CASE WHEN p > 1e-4 AND p < 1 - 1e-4 THEN (1 - y) - y * (1 - p) / p ELSE 0 END AS slope, CASE WHEN z0 + z1 * x1 + z2 * x2 > 0 THEN a ELSE 0 END AS one, CASE WHEN z3 + z4 * x3 + z5 * x4 > 0 THEN b ELSE 0 END AS two
                  FROM (SELECT it.*, training.* EXCLUDE segment, scales.* EXCLUDE segment, {_CHANCE.format("z")} AS p FROM it JOIN training USING (segment) JOIN scales USING (segment)))
            GROUP BY k, segment, s, {", ".join(f"t{i}, z{i}" for i in range(6))}) WHERE k < 600),
    ends AS (SELECT segment, s, any_value(n) AS n, sum(w * loss) / sum(w) AS loss, any_value(-(rate * ln(rate) + (1 - rate) * ln(1 - rate))) AS base_loss, sum(w * p) / sum(w) AS mean_chance
             FROM (SELECT *, -(y * ln(p) + (1 - y) * ln(1 - p)) AS loss FROM (SELECT training.*, s, n, rate, {_CHANCE.format("t")} AS p FROM it JOIN training USING (segment) JOIN scales USING (segment) WHERE k = 600)) GROUP BY 1, 2)
    SELECT segment, any_value(n) AS n, round(min(loss), 5) AS loss, round(any_value(base_loss), 5) AS base_loss, round(arg_min(mean_chance, loss), 3) AS mean_chance FROM ends GROUP BY 1"""


@query(EVENT_FIT_SQL)
def bounded_event_fit(spark, sf_dir):
    """Weighted log loss of each segment's fitted chance of an event of either kind, beside that of its mean rate, over unrounded rows."""
    rows = save(two_part_rows(spark, sf_dir), "two-part-rows")
    found = events_fit.fit_events(rows, "segment")
    schema = "segment string, loss double, " + ", ".join(f"t{i} double" for i in range(6))
    theta = spark.createDataFrame([(g, float(loss), *map(float, t)) for g, (t, loss) in found.items()], schema)
    met = rows.join(F.broadcast(theta), "segment")  # a row for each segment
    w, rate = F.col("w"), F.sum(F.col("w") * F.col("y")) / F.sum("w")
    out = met.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.max("loss").alias("loss"), (-(rate * F.ln(rate) + (1 - rate) * F.ln(1 - rate))).alias("base_loss"), (F.sum(w * events_fit.chance([F.col(f"t{i}") for i in range(6)])) / F.sum(w)).alias("mean_chance"))
    return rounded(rounded(out, "loss", "base_loss", digits=5), "mean_chance", digits=3)


@query()
def bounded_event_coefficients(spark, sf_dir):
    """The coefficients themselves: two intercepts, which may be negative, and the weights of usage and history, which may not."""
    found = events_fit.fit_events(save(two_part_rows(spark, sf_dir), "two-part-rows"), "segment")
    terms = [f"{side}_{term}" for side in ("urgent", "high") for term in ("intercept", "usage", "history")]
    rows = [(g, term, round(float(v), 6)) for g, (theta, _) in sorted(found.items()) for term, v in zip(terms, theta)]
    return spark.createDataFrame(rows, "segment string, term string, value double")


@query(f"""WITH {GAMES}, periods AS (SELECT team, period, sum(urgent) AS urgent, count(*) AS n, row_number() OVER (PARTITION BY team ORDER BY period DESC) AS ago FROM games GROUP BY 1, 2),
    recent AS (SELECT team, sum(urgent) AS urgent, sum(n) AS n FROM periods WHERE ago <= 8 GROUP BY 1), league AS (SELECT avg(urgent) AS p FROM games)
    SELECT team, round(least(0.8, greatest(0.05, (urgent + p * 12.0) / (n + 12.0))), 6) AS share FROM recent, league""")
def shrunk_team_share(spark, sf_dir):
    """A team's share over its last eight periods, shrunk to the league's by twelve events and held within bounds."""
    rows = save(games(spark, sf_dir).groupBy("team", "period").agg(F.sum("urgent").alias("urgent"), F.count(F.lit(1)).alias("n")), "team-periods")
    league = rows.agg((F.sum("urgent") / F.sum("n")).alias("p"))
    recent = rank.top_k(rows, ["team"], [F.desc("period")], 8).groupBy("team").agg(F.sum("urgent").alias("urgent"), F.sum("n").alias("n")).crossJoin(F.broadcast(league))  # a single row
    share = (F.col("urgent") + F.col("p") * 12.0) / (F.col("n") + 12.0)
    return recent.select("team", F.round(F.least(F.lit(0.8), F.greatest(F.lit(0.05), share)), 6).alias("share"))


@query("""WITH tries AS (SELECT c_mktsegment AS segment, floor(l_quantity / 5)::BIGINT * 5 AS distance, count(*)::DOUBLE AS n, avg((l_returnflag = 'R')::INT) AS made
                         FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    league AS (SELECT distance, sum(n * made) / sum(n) AS made FROM tries GROUP BY 1)
    SELECT segment, round(sum(n * league.made) / sum(n), 6) AS expected, round(sum(n * tries.made) / sum(n), 6) AS actual, count(*)::BIGINT AS bands FROM tries JOIN league USING (distance) GROUP BY 1""")
def expected_rate_of_mix(spark, sf_dir):
    """The rate that a segment's own mix of distances would give at the league's rate for each distance, beside its actual one."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", "l_returnflag").join(orders.select("o_orderkey", "segment"), "o_orderkey")
    tries = lines.groupBy("segment", (big(F.floor(F.col("l_quantity") / 5)) * 5).alias("distance")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("made"))
    tries = save(tries, "tries")
    league = tries.groupBy("distance").agg((F.sum(F.col("n") * F.col("made")) / F.sum("n")).alias("league"))
    rows = tries.join(league, "distance").groupBy("segment").agg((F.sum(F.col("n") * F.col("league")) / F.sum("n")).alias("expected"), (F.sum(F.col("n") * F.col("made")) / F.sum("n")).alias("actual"), F.count(F.lit(1)).alias("bands"))
    return rounded(rows, "expected", "actual")


#: Targets of the environment models, each with the bounds of its predictions (fixed values); predictors are the total and the own spread.
TARGETS = {"lines": (1.0, 20.0), "quantity": (10.0, 500.0), "returned": (0.0, 300.0), "open_rate": (0.05, 0.95), "discount": (0.0, 0.1), "parts": (1.0, 20.0), "tax": (0.0, 0.08)}
LEAST_ROWS = 500
FRAME = """
    frame AS (SELECT o_orderkey, o_totalprice / 10000 AS total, c_acctbal / 1000 AS spread, l.* EXCLUDE l_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
              JOIN (SELECT l_orderkey, count(*)::DOUBLE AS lines, sum(l_quantity) AS quantity, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS returned,
                           avg((l_linestatus = 'O')::INT) AS open_rate, avg(l_discount) AS discount, count(DISTINCT l_partkey)::DOUBLE AS parts, avg(l_tax) AS tax FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey)"""
_STACK = " UNION ALL ".join(f"SELECT o_orderkey, total, spread, '{t}' AS target, {t} AS y, {lo} AS low, {hi} AS high FROM frame" for t, (lo, hi) in TARGETS.items())
MODELS = FRAME + f""",
    stacked AS ({_STACK}),
    sums AS (SELECT target, count(*)::BIGINT AS n, avg(total) AS mt, avg(spread) AS ms, avg(y) AS my, var_pop(total) AS tt, var_pop(spread) AS ss, covar_pop(total, spread) AS ts,
                    covar_pop(total, y) AS ty, covar_pop(spread, y) AS sy, var_pop(y) AS yy FROM stacked GROUP BY 1 HAVING count(*) >= 500),
    slopes AS (SELECT *, (ty * ss - sy * ts) / (tt * ss - ts * ts) AS by_total, (sy * tt - ty * ts) / (tt * ss - ts * ts) AS by_spread FROM sums WHERE tt * ss - ts * ts > 1e-12),
    models AS (SELECT target, n, by_total, by_spread, my - by_total * mt - by_spread * ms AS intercept, (by_total * ty + by_spread * sy) / nullif(yy, 0) AS r2,
                      sqrt(greatest(0, yy - by_total * ty - by_spread * sy)) AS rmse FROM slopes)"""


def training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per game: the market's total, the own spread, and what happened."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).cast("double").alias("lines"), F.sum("l_quantity").alias("quantity"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("returned"),
        F.avg((F.col("l_linestatus") == "O").cast("int")).alias("open_rate"), F.avg("l_discount").alias("discount"), F.countDistinct("l_partkey").cast("double").alias("parts"), F.avg("l_tax").alias("tax"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 10000).alias("total"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") / 1000).alias("spread"))
    return orders.join(people, "o_custkey").join(lines, "o_orderkey").select("o_orderkey", "total", "spread", *TARGETS)


def stacked(frame: DataFrame) -> DataFrame:
    one = [F.struct(F.lit(t).alias("target"), F.col(t).alias("y"), F.lit(lo).alias("low"), F.lit(hi).alias("high")) for t, (lo, hi) in TARGETS.items()]
    return frame.select("o_orderkey", "total", "spread", F.explode(F.array(*one)).alias("m")).select("o_orderkey", "total", "spread", "m.*")


def environment_fits(frame: DataFrame) -> DataFrame:
    """Least squares on two predictors for every target with ``LEAST_ROWS`` rows or more, from ten sums in one aggregate."""
    v, c = F.var_pop, F.covar_pop
    sums = stacked(frame).groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), F.avg("total").alias("mt"), F.avg("spread").alias("ms"), F.avg("y").alias("my"), v("total").alias("tt"), v("spread").alias("ss"), c("total", "spread").alias("ts"),
        c("total", "y").alias("ty"), c("spread", "y").alias("sy"), v("y").alias("yy")).filter(F.col("n") >= LEAST_ROWS)
    det = F.expr("tt * ss - ts * ts")
    rows = sums.filter(det > 1e-12).withColumns({"by_total": F.expr("ty * ss - sy * ts") / det, "by_spread": F.expr("sy * tt - ty * ts") / det})
    return rows.selectExpr("target", "n", "by_total", "by_spread", "my - by_total * mt - by_spread * ms AS intercept", "(by_total * ty + by_spread * sy) / nullif(yy, 0) AS r2", "sqrt(greatest(0D, yy - by_total * ty - by_spread * sy)) AS rmse")


@query(f"WITH {FRAME} SELECT o_orderkey, round(total, 6) AS total, round(spread, 6) AS spread, lines, round(quantity, 4) AS quantity, round(discount, 6) AS discount FROM frame")
def environment_training_frame(spark, sf_dir):
    return rounded(rounded(training_frame(spark, sf_dir).select("o_orderkey", "total", "spread", "lines", "quantity", "discount"), "total", "spread", "discount"), "quantity", digits=4)


@query(f"WITH {MODELS} SELECT target, n, round(by_total, 6) AS by_total, round(by_spread, 6) AS by_spread, round(intercept, 5) AS intercept, round(r2, 6) AS r2, round(rmse, 5) AS rmse FROM models")
def environment_models(spark, sf_dir):
    return rounded(rounded(environment_fits(training_frame(spark, sf_dir)), "by_total", "by_spread", "r2"), "intercept", "rmse", digits=5)


@query(f"""WITH {MODELS} SELECT o_orderkey, target, round(least(high, greatest(low, intercept + by_total * total + by_spread * spread)), 5) AS predicted
    FROM stacked JOIN models USING (target)""")
def environment_scored(spark, sf_dir):
    """The fitted models on every game, held within each target's bounds."""
    frame = save(training_frame(spark, sf_dir), "training-frame")
    rows = stacked(frame).join(F.broadcast(environment_fits(frame).drop("n", "r2", "rmse")), "target")  # a row for each target
    y = F.col("intercept") + F.col("by_total") * F.col("total") + F.col("by_spread") * F.col("spread")
    return rows.select("o_orderkey", "target", F.round(F.least("high", F.greatest("low", y)), 5).alias("predicted"))


#: What is projected for each segment: (statistic, mean, variance) over the blended columns (specification).
SPEC = {
    "AUTOMOBILE": (("value", "mean", "variance"), ("per_game", "mean / n_games", "variance / (n_games * n_games)")),
    "BUILDING": (("value", "mean", "variance"), ("share", "share", "share * (1 - share) / (n_games + 1)")),
    "FURNITURE": (("value", "mean", "variance"),),
    "HOUSEHOLD": (("value", "0.5 * mean + 0.5 * prior_mean", "0.25 * variance + 0.25 * prior_variance"), ("share", "share", "share * (1 - share) / (n_games + 1)")),
    "MACHINERY": (("value", "mean", "variance"), ("over_prior", "mean - prior_mean", "variance + prior_variance")),
}


@query(f"WITH {PRIORS} " + " UNION ALL ".join(f"SELECT entity, segment, '{stat}' AS stat, round({m}, 4) AS mean, round({v}, 2) AS variance FROM blend WHERE segment = '{segment}'" for segment, own in SPEC.items() for stat, m, v in own))
def segment_projections(spark, sf_dir):
    """Projections by specification: the segment chooses the statistics, one pass makes them."""
    def made(own):
        return F.array(*[F.struct(F.lit(stat).alias("stat"), F.expr(m).alias("mean"), F.expr(v).alias("variance")) for stat, m, v in own])

    chosen = F.lit(None)
    for segment, own in SPEC.items():
        chosen = F.when(F.col("segment") == segment, made(own)).otherwise(chosen)
    rows = blend(spark, sf_dir).select("entity", "segment", F.explode(chosen).alias("p")).select("entity", "segment", "p.*")
    return rounded(rounded(rows, "mean", digits=4), "variance", digits=2)


REPLAY = MONTHS + """,
    cells AS (SELECT segment, period, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM months GROUP BY 1, 2),
    refits AS (SELECT segment, period, sum(n) OVER w AS n, sum(s) OVER w / sum(n) OVER w AS prior, sum(q) OVER w / sum(n) OVER w - (sum(s) OVER w / sum(n) OVER w) ** 2 AS spread
               FROM cells WINDOW w AS (PARTITION BY segment ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    history AS (SELECT entity, segment, season, period, value, count(*) OVER w AS k, coalesce(avg(value) OVER w, 0) AS own FROM months WINDOW w AS (PARTITION BY entity ORDER BY period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
    replayed AS (SELECT entity, segment, season, period, value AS actual, (k * own + 2 * prior) / (k + 2) AS projected, sqrt(spread) AS sd
                 FROM history JOIN refits USING (segment, period) WHERE n >= 100 AND spread > 0)"""


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every month as it would have been projected before it was played: the segment's prior and spread are refitted on all periods
    before (running sums of its cells), the entity's level is the mean of its last four months before. All cutoffs in one job."""
    rows = save(months(spark, sf_dir), "months")
    x = F.col("value")
    cells = rows.groupBy("segment", "period").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    before = Window.partitionBy("segment").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    n, s, q = (F.sum(c).over(before) for c in "nsq")
    refits = cells.select("segment", "period", n.alias("seen"), (s / n).alias("prior"), (q / n - F.pow(s / n, 2)).alias("spread")).filter("seen >= 100 AND spread > 0")
    last = Window.partitionBy("entity").orderBy("period").rowsBetween(-4, -1)
    history = rows.select("entity", "segment", "season", "period", x.alias("actual"), F.count(F.lit(1)).over(last).alias("k"), F.coalesce(F.avg("value").over(last), F.lit(0.0)).alias("own"))
    projected = (F.col("k") * F.col("own") + 2 * F.col("prior")) / (F.col("k") + 2)
    return history.join(refits, ["segment", "period"]).select("entity", "segment", "season", "period", "actual", projected.alias("projected"), F.sqrt("spread").alias("sd"))


@query(f"WITH {REPLAY} SELECT entity, period, round(actual, 6) AS actual, round(projected, 4) AS projected, round(sd, 4) AS sd FROM replayed")
def walk_forward_replay(spark, sf_dir):
    return rounded(rounded(replayed(spark, sf_dir).select("entity", "period", "actual", "projected", "sd"), "actual"), "projected", "sd", digits=4)


@query(f"""WITH {REPLAY} SELECT segment, season, count(*)::BIGINT AS n, round(avg(abs(actual - projected)), 4) AS mae, round(avg(projected - actual), 4) AS bias,
    round(avg((abs(actual - projected) <= 0.6744897501960817 * sd)::INT), 6) AS coverage, round(1 - sum((actual - projected) ** 2) / sum((actual - league) ** 2), 5) AS gain
    FROM (SELECT *, avg(actual) OVER (PARTITION BY segment, season) AS league FROM replayed) GROUP BY 1, 2""")
def replay_scorecard(spark, sf_dir):
    """Errors, bias, coverage of the middle half, and the reduction of squared error against the season's own mean."""
    x, y = F.col("actual"), F.col("projected")
    cells = replayed(spark, sf_dir).groupBy("segment", "season").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(x - y)).alias("mae"), F.avg(y - x).alias("bias"), F.avg((F.abs(x - y) <= 0.6744897501960817 * F.col("sd")).cast("int")).alias("coverage"),
        (1 - F.sum((x - y) * (x - y)) / (F.var_pop(x) * F.count(F.lit(1)))).alias("gain"))
    return rounded(rounded(rounded(cells, "mae", "bias", digits=4), "coverage"), "gain", digits=5)


PIT = GAMES + """,
    years AS (SELECT entity, segment, season, count(*)::BIGINT AS x FROM games GROUP BY 1, 2, 3),
    spine AS (SELECT entity, any_value(segment) AS segment, unnest(range(min(season), (SELECT max(season) FROM years) + 1)) AS season FROM years GROUP BY 1),
    filled AS (SELECT entity, spine.segment, season, coalesce(x, 0) AS x FROM spine LEFT JOIN years USING (entity, season)),
    prior_years AS (SELECT *, avg(x) OVER (PARTITION BY entity ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM filled),
    probabilities AS (SELECT entity, segment, season, x, m, list_sum(list_transform(range(0, x), lambda k: exp(-m + k * ln(m) - lgamma(k + 1)))) AS below, exp(-m + x * ln(m) - lgamma(x + 1)) AS here FROM prior_years WHERE m > 0),
    pits AS (SELECT *, coalesce(below, 0) + here / 2 AS pit, 1 - exp(-m) AS p_any FROM probabilities)"""


@query(f"""WITH {PIT} SELECT segment, count(*)::BIGINT AS n, round(avg(pit), 5) AS mean_pit, round(avg((pit BETWEEN 0.25 AND 0.75)::INT), 6) AS middle, round(avg((p_any - (x > 0)::INT) ** 2), 5) AS brier,
    round(sum(m * abs(x - m)) / sum(m), 5) AS weighted_error FROM pits WHERE m <> x GROUP BY 1""")
def poisson_pit_scorecard(spark, sf_dir):
    """Yearly counts, zero in the years from the first on that have none, against a Poisson law with the mean of the years before:
    middle of the jump at the actual count, score of "any event", and an error weighted by the mean over cells that do not hit it exactly."""
    years = save(games(spark, sf_dir).groupBy("entity", "segment", "season").agg(F.count(F.lit(1)).alias("x")), "years")
    last = years.agg(F.max("season").alias("last"))
    spine = years.groupBy("entity").agg(F.min("segment").alias("segment"), F.min("season").alias("first")).crossJoin(F.broadcast(last))  # a single row
    spine = spine.select("entity", "segment", F.explode(F.sequence("first", "last")).alias("season"))
    filled = spine.join(years.select("entity", "season", "x"), ["entity", "season"], "left").withColumn("x", F.coalesce("x", F.lit(0)))
    before = Window.partitionBy("entity").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    rows = filled.withColumn("m", F.avg("x").over(before)).filter("m > 0")
    rows = rows.withColumn("pit", laws.mid_pit(F.col("x"), laws.poisson(F.col("m")))).filter("m != x")
    out = rows.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), F.avg("pit").alias("mean_pit"), F.avg(F.col("pit").between(0.25, 0.75).cast("int")).alias("middle"),
        F.avg(F.pow(1 - F.exp(-F.col("m")) - (F.col("x") > 0).cast("int"), 2)).alias("brier"), (F.sum(F.col("m") * F.abs(F.col("x") - F.col("m"))) / F.sum("m")).alias("weighted_error"))
    return rounded(rounded(out, "mean_pit", "brier", "weighted_error", digits=5), "middle")
