"""Projections of five positions by specification: volume from the team's environment, shares, opponents, efficiency, events.

Market segments are positions. Every figure that a statistic uses is a step, and the trace shows it with its section.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import laws
from ..operators import rank, spec
from ..operators.spec import Position, Stat, Step
from ..shared import importable, save
from . import calibrated, projection, ratings
from .registry import big, query, rounded

_VALUE = (
    Step("environment", "team_value", "team_value", "team expected value a month"),
    Step("usage", "share", "least(0.9, greatest(0.001, share))", "share of the team value", "n_games"),
    Step("opponent", "multiplier", "multiplier", "counterparty multiplier", "team"),
    Step("usage", "value", "team_value * share * multiplier", "projected value"),
)


def _orders(of: str) -> tuple[Step, ...]:
    return (Step("efficiency", "per_order", "CASE WHEN per_order > 0 THEN per_order ELSE 200.0 END", "value of an order", "n_games"), Step("usage", "orders", f"{of} / per_order", "projected orders"))


_URGENT = (
    Step("events", "urgent_rate", "(urgent_rate * n_eff + 0.2 * 3) / (n_eff + 3)", "urgent orders an order, shrunk"),
    Step("events", "urgent", "orders * urgent_rate", "projected urgent orders"),
    Step("events", "any_urgent", "1 - exp(-urgent)", "chance of any urgent order"),
)
_VALUE_STAT, _ORDERS_STAT = Stat("value", "amount", ("team_value", "share", "multiplier", "value")), Stat("orders", "count", ("team_value", "share", "multiplier", "value", "per_order", "orders"))
#: The positions (specification).
POSITIONS = (
    Position("AUTOMOBILE", (*_VALUE, *_orders("value"), *_URGENT), (_VALUE_STAT, _ORDERS_STAT, Stat("urgent", "count", ("orders", "urgent_rate", "urgent")), Stat("any_urgent", "event", ("orders", "urgent_rate", "urgent", "any_urgent")))),
    Position(
        "BUILDING",
        (*_VALUE, Step("usage", "freed", "0.1 * (1 - share)", "dealt from absent shares"), Step("usage", "value_dealt", "value + team_value * freed * 0.05 * multiplier", "value with dealt shares"), *_orders("value_dealt")),
        (Stat("value", "amount", ("team_value", "share", "multiplier", "freed", "value_dealt")), Stat("orders", "count", ("value_dealt", "per_order", "orders")))),
    Position(
        "FURNITURE",
        (Step("baseline", "own", "mean", "recency-weighted value", "n_games"), Step("baseline", "weight", "n_eff / (n_eff + 3)", "weight of the own record"), Step("baseline", "prior_mean", "prior_mean", "mean of the position"),
         Step("baseline", "blended", "weight * own + (1 - weight) * prior_mean", "blended baseline"), Step("opponent", "multiplier", "multiplier", "counterparty multiplier", "team"), Step("baseline", "value", "blended * multiplier", "projected value"), *_orders("value"), *_URGENT),
        (Stat("value", "amount", ("own", "weight", "prior_mean", "blended", "multiplier", "value")), Stat("orders", "count", ("value", "per_order", "orders")), Stat("any_urgent", "event", ("orders", "urgent_rate", "urgent", "any_urgent")))),
    Position(
        "HOUSEHOLD",
        (*_VALUE, Step("weather", "season_effect", "CASE WHEN month_of_year IN (11, 12) THEN 1.05 WHEN month_of_year IN (1, 2) THEN 0.96 ELSE 1.0 END", "season", "month_of_year"), Step("weather", "value_in_season", "value * season_effect", "value in season"),
         *_orders("value_in_season")),
        (Stat("value", "amount", ("team_value", "share", "multiplier", "season_effect", "value_in_season")), Stat("orders", "count", ("value_in_season", "per_order", "orders")))),
    Position(
        "MACHINERY",
        (*_VALUE, *_orders("value"), *_URGENT, Step("combined", "points", "orders + 3 * urgent", "orders and urgent ones three times over")),
        (_VALUE_STAT, Stat("urgent", "count", ("orders", "urgent_rate", "urgent")), Stat("points", "count", ("orders", "urgent", "points")))),
)

INPUTS = f"{projection.PRIORS}, {ratings.MULTIPLIERS}" + """,
    team_recent AS (SELECT team, avg(team_value) AS team_value FROM (SELECT team, team_value, row_number() OVER (PARTITION BY team ORDER BY period DESC) AS r FROM teams) WHERE r <= 6 GROUP BY 1),
    own_recent AS (SELECT entity, sum(value) / nullif(sum(n), 0) AS per_order, sum(urgent) / nullif(sum(n), 0) AS urgent_rate, max(period) AS last_period FROM latest GROUP BY 1),
    inputs AS (SELECT usage.entity, usage.team, usage.segment, usage.n_games, usage.share, usage.mean, usage.n_eff, usage.variance, prior_mean, team_recent.team_value, per_order, urgent_rate, ((last_period % 12) + 1)::BIGINT AS month_of_year,
                      coalesce(multiplier, 1.0) AS multiplier, least(1.0, usage.n_games / 6.0) AS play
               FROM usage JOIN priors USING (segment) JOIN team_recent USING (team) JOIN own_recent USING (entity) LEFT JOIN (SELECT team, multiplier FROM multipliers WHERE metric = 'net_price') USING (team))"""
GIVEN = "entity team segment n_games share mean n_eff variance prior_mean team_value per_order urgent_rate month_of_year multiplier play".split()
STEPS = f"{INPUTS}, steps AS ({spec.compile_sql('inputs', POSITIONS, 'segment', ('entity', 'segment'), GIVEN)})"


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the specifications read, a row for each entity."""
    own = save(projection.usage(spark, sf_dir), "usage")
    months = save(projection.months(spark, sf_dir), "months")
    prior = months.groupBy("segment").agg(F.avg("value").alias("prior_mean"))
    teams = months.groupBy("team", "period").agg(F.sum("value").alias("team_value"))
    recent = rank.top_k(teams, ["team"], [F.desc("period")], 6).groupBy("team").agg(F.avg("team_value").alias("team_value"))
    last = rank.top_k(months, ["entity"], [F.desc("period")], projection.RECENT).groupBy("entity").agg(
        (F.sum("value") / F.sum("n")).alias("per_order"), (F.sum("urgent") / F.sum("n")).alias("urgent_rate"), F.max("period").alias("last_period"))
    factors = ratings.multipliers(spark, sf_dir, "net_price").select("team", "multiplier")
    rows = own.join(F.broadcast(prior), "segment").join(F.broadcast(recent), "team").join(F.broadcast(factors), "team", "left").join(last, "entity")  # rows for segments and nations
    rows = rows.withColumns({"month_of_year": big(F.col("last_period") % 12 + 1), "multiplier": F.coalesce("multiplier", F.lit(1.0)), "play": F.least(F.lit(1.0), F.col("n_games") / 6.0)})
    return rows.select(*GIVEN)


def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = save(inputs(spark, sf_dir), "inputs")
    return spec.compile_all(rows, POSITIONS, "segment", ["entity", "segment", "play"])


@query(f"WITH {STEPS} SELECT entity, segment, stat, step, section, label, round(value + 1e-7, 5) AS value, detail FROM steps")
def projection_trace(spark, sf_dir):
    """Every projection as the chain of its named steps; values that end in a half of the last digit go up."""
    rows = spec.trace(projections(spark, sf_dir), ["entity", "segment"])
    return rounded(rows.withColumn("value", F.col("value") + 1e-7), "value", digits=5)


@query(f"""WITH {STEPS},
    means AS (SELECT s.entity, s.segment, stat, family, value AS mean, play FROM steps s JOIN inputs USING (entity) WHERE last),
    spreads AS (SELECT *, CASE WHEN family = 'amount' THEN greatest(1.05 * m, m + 0.4 * m * m) END AS spread FROM (SELECT *, round(mean, 9) AS m FROM means WHERE family <> 'event')),
    terms AS (SELECT *, {calibrated.mass_sql("j", "spread")} AS p FROM (SELECT *, unnest(range(0, 3 + ceil(m + 1.7320508075688772 * sqrt(coalesce(spread, m)))::BIGINT)) AS j FROM spreads WHERE m > 0)),
    walked AS (SELECT entity, stat, j, sum(p) OVER (PARTITION BY entity, stat ORDER BY j) AS f FROM terms),
    laws AS (SELECT entity, stat, min(j) FILTER (f >= 0.25 - 1e-12)::DOUBLE AS p25, min(j) FILTER (f >= 0.5 - 1e-12)::DOUBLE AS median, min(j) FILTER (f >= 0.75 - 1e-12)::DOUBLE AS p75 FROM walked GROUP BY 1, 2)
    SELECT entity, segment, stat, family, round(mean, 5) AS mean, round(play * mean, 5) AS unconditional_mean, p25, median, p75 FROM means LEFT JOIN laws USING (entity, stat)""")
def position_projections(spark, sf_dir):
    """Each statistic's mean, quartiles under its family's law, and mean whether or not the entity plays; an event has its chance alone."""
    importable(spark)
    rows = projections(spark, sf_dir).drop("trace")
    m = F.when(F.col("family") != "event", F.round("mean", 9))
    spread = F.when(F.col("family") == "amount", F.greatest(1.05 * m, m + 0.4 * m * m))
    rows = rows.withColumn("q", laws.spread_quantiles([0.25, 0.5, 0.75], m, spread))
    out = rows.select("entity", "segment", "stat", "family", "mean", (F.col("play") * F.col("mean")).alias("unconditional_mean"), F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"))
    return rounded(out, "mean", "unconditional_mean", digits=5)
