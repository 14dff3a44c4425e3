"""Nested reads: a board with its entries and their headline projections, an entity's page with everything on it.

Each grain is aggregated to the entity on its own and joined once, so no grain multiplies another; what comes back are structs,
maps and arrays. The flat forms read the nested ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rank
from ..shared import save, table
from . import projection, specified
from .registry import big, query

SHOWN, LOGGED = 10, 6


def headline(projections: DataFrame) -> DataFrame:
    """(entity, headline): the entity's projections by statistic, conditional and whether or not it plays."""
    entry = F.struct("family", F.round("mean", 5).alias("mean"), F.round(F.col("play") * F.col("mean"), 5).alias("unconditional_mean"))
    return projections.groupBy("entity").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stat", entry.alias("projection"))))).alias("headline"))


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment, rows): each position's best by projected value, as an array in their order."""
    made = save(specified.projections(spark, sf_dir), "projections")
    inputs = save(specified.inputs(spark, sf_dir).select("entity", "team", "n_games", "multiplier", "play"), "board-inputs")
    value = made.filter("stat = 'value'").select("entity", "segment", F.round("mean", 5).alias("score"))
    best = save(rank.top_k(value, ["segment"], [F.desc("score"), F.asc("entity")], SHOWN, "rank"), "board-best")
    shown = headline(made.join(F.broadcast(best.select("entity")), "entity", "left_semi"))  # ten of each position
    rows = best.join(inputs, "entity").join(shown, "entity").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name")), "entity", "left")
    entry = F.struct("rank", "entity", F.coalesce("name", F.col("entity").cast("string")).alias("name"), "team", "score", (F.col("n_games") < 3).alias("insufficient_history"), F.round("play", 6).alias("play"), F.round("multiplier", 6).alias("multiplier"), "headline")
    return rows.groupBy("segment").agg(F.array_sort(F.collect_list(entry), lambda a, b: (a["rank"] - b["rank"]).cast("int")).alias("rows"))


@query()
def board_nested(spark, sf_dir):
    return board(spark, sf_dir)


_FLAT = """
    means AS (SELECT s.entity, s.segment, stat, family, value AS mean FROM steps s WHERE last),
    best AS (SELECT entity, segment, round(mean, 5) AS score, row_number() OVER (PARTITION BY segment ORDER BY round(mean, 5) DESC, entity) AS rank FROM means WHERE stat = 'value' QUALIFY rank <= 10)"""


@query(f"""WITH {specified.STEPS}, {_FLAT}
    SELECT best.segment, best.rank::BIGINT AS rank, best.entity, coalesce(c_name, best.entity::VARCHAR) AS name, inputs.team, score, n_games < 3 AS insufficient_history, round(multiplier, 6) AS multiplier, m.stat, m.family, round(m.mean, 5) AS mean, round(play * m.mean, 5) AS unconditional_mean
    FROM best JOIN inputs USING (entity) JOIN means m ON m.entity = best.entity LEFT JOIN customer ON c_custkey = best.entity""")
def board_flat(spark, sf_dir):
    """The nested board's entries and projections as rows."""
    rows = board(spark, sf_dir).select("segment", F.explode("rows").alias("r")).select("segment", "r.*")
    rows = rows.select("*", F.explode("headline").alias("stat", "p"))
    return rows.select("segment", "rank", "entity", "name", "team", "score", "insufficient_history", "multiplier", "stat", "p.family", "p.mean", "p.unconditional_mean")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entity: bio as a struct, projections as a map from statistic to projection with its trace, the last months as an
    array of structs, recent seasons as a map."""
    made = save(specified.projections(spark, sf_dir), "projections")
    steps = F.transform("trace", lambda t: F.struct(t["section"].alias("section"), t["label"].alias("label"), F.round(t["value"] + 1e-7, 5).alias("value")))
    entry = F.struct("family", F.round("mean", 5).alias("mean"), steps.alias("trace"))
    stats = made.groupBy("entity").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stat", entry.alias("p"))))).alias("projections"))
    months = save(projection.months(spark, sf_dir), "months")
    last = rank.top_k(months, ["entity"], [F.desc("period")], LOGGED)
    log = last.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("place", "period", "n", F.round(F.col("value") + 1e-7, 4).alias("value"), "urgent"))).alias("log"))
    by_season = months.groupBy("entity", "season").agg(F.sum("n").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    seasons = by_season.groupBy("entity").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("season", F.struct("n", "value").alias("s"))))).alias("seasons"))
    bio = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.struct(F.col("c_name").alias("name"), big(F.col("c_nationkey")).alias("team"), F.col("c_mktsegment").alias("segment")).alias("bio"))
    return bio.join(stats, "entity", "left").join(log, "entity", "left").join(seasons, "entity", "left")


@query()
def entity_profiles(spark, sf_dir):
    return profiles(spark, sf_dir)


@query(f"""WITH {specified.STEPS},
    told AS (SELECT entity, count(DISTINCT stat)::BIGINT AS stats, count(*)::BIGINT AS steps, round(max(CASE WHEN last AND stat = 'value' THEN value END), 5) AS value FROM steps GROUP BY 1),
    recent AS (SELECT entity, count(*)::BIGINT AS logged, round(sum(round(value + 1e-7, 4)), 4) AS logged_value, max(period) AS last_period FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period DESC) AS k FROM months) WHERE k <= 6 GROUP BY 1),
    seasons AS (SELECT entity, count(DISTINCT season)::BIGINT AS seasons, sum(n)::BIGINT AS n FROM months GROUP BY 1)
    SELECT c_custkey AS entity, c_name AS name, c_nationkey::BIGINT AS team, coalesce(stats, 0)::BIGINT AS stats, coalesce(steps, 0)::BIGINT AS steps, value, coalesce(logged, 0)::BIGINT AS logged, logged_value, last_period, coalesce(seasons, 0)::BIGINT AS seasons, coalesce(n, 0)::BIGINT AS n
    FROM customer LEFT JOIN told ON told.entity = c_custkey LEFT JOIN recent ON recent.entity = c_custkey LEFT JOIN seasons ON seasons.entity = c_custkey""")
def profile_digest(spark, sf_dir):
    """What the nested profiles hold, counted and summed from their arrays and maps; an entity without any record has an empty page."""
    rows = profiles(spark, sf_dir)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    known = lambda c: F.when(F.col(c).isNotNull(), size(c)).otherwise(F.lit(0).cast("long"))
    steps = F.aggregate(F.map_values("projections"), F.lit(0).cast("long"), lambda a, p: a + F.size(p["trace"]))
    total = F.aggregate("log", F.lit(0.0), lambda a, m: a + m["value"])
    games = F.aggregate(F.map_values("seasons"), F.lit(0).cast("long"), lambda a, s: a + s["n"])
    return rows.select(
        "entity", "bio.name", "bio.team", known("projections").alias("stats"), F.coalesce(steps, F.lit(0)).cast("long").alias("steps"), F.try_element_at("projections", F.lit("value"))["mean"].alias("value"),
        known("log").alias("logged"), F.round(total, 4).alias("logged_value"), F.get("log", F.lit(0))["period"].alias("last_period"), known("seasons").alias("seasons"), F.coalesce(games, F.lit(0)).cast("long").alias("n"))
