"""Read models: nested rows as an API serves them, and counts of all relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asof, rank
from ..shared import table
from .registry import query

RELATIONS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS relation, count(*)::BIGINT AS n FROM {t}" for t in RELATIONS))
def table_counts(spark, sf_dir):
    """Row counts; Parquet answers them from its footers."""
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, t).agg(F.lit(t).alias("relation"), F.count(F.lit(1)).alias("n")).select("relation", "n") for t in RELATIONS])


@query("""
    SELECT o_custkey, string_agg(o_orderkey || ':' || round(o_totalprice)::BIGINT, ',' ORDER BY k) AS log, count(*)::BIGINT AS n FROM (
    SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 6 GROUP BY 1""")
def entity_log(spark, sf_dir):
    """The last six rows of each entity as one nested, ordered value."""
    rows = asof.last_n(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 6, "k")
    item = F.struct("k", F.concat_ws(":", "o_orderkey", F.round("o_totalprice").cast("long")).alias("t"))
    return rows.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.t), ",").alias("log"), F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT c_mktsegment, c_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY total DESC, c_custkey) AS place FROM t)
    SELECT c_mktsegment, string_agg(place || '.' || c_custkey || '.' || n, ';' ORDER BY place) AS board FROM b WHERE place <= 5 GROUP BY 1""")
def segment_board(spark, sf_dir):
    """A board of each segment's five best entities, nested."""
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"))
    rows = rank.top_k(own.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey"), ["c_mktsegment"], [F.desc("total"), F.asc("c_custkey")], 5)
    item = F.struct("place", F.concat_ws(".", "place", "c_custkey", "n").alias("t"))
    return rows.groupBy("c_mktsegment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.t), ";").alias("board"))


TICKETS = "concat_ws(';', concat_ws(':', user_id, event_type, floor(value) + 0.5, 'over'), concat_ws(':', user_id, 'any', floor(value / 2), 'under'), concat_ws(':', event_id % 7, event_type, 1, 'over'))"


@query(f"""SELECT event_id, leg::BIGINT AS leg, split_part(t, ':', 1) AS name, split_part(t, ':', 2) AS stat, split_part(t, ':', 3)::DOUBLE AS line, split_part(t, ':', 4) AS side FROM (
    SELECT event_id, unnest(string_split(ticket, ';')) AS t, generate_subscripts(string_split(ticket, ';'), 1) - 1 AS leg FROM (SELECT event_id, {TICKETS} AS ticket FROM events))""")
def parlay_legs(spark, sf_dir):
    """``name:stat:line:side`` legs of joint bets as rows; each event is written as such a ticket first."""
    tickets = table(spark, sf_dir, "events").select("event_id", F.expr(TICKETS).alias("ticket"))
    rows = tickets.select("event_id", F.posexplode(F.split("ticket", ";")).alias("leg", "t"))
    p = F.split("t", ":")
    return rows.select("event_id", F.col("leg").cast("long").alias("leg"), p[0].alias("name"), p[1].alias("stat"), p[2].cast("double").alias("line"), p[3].alias("side"))
