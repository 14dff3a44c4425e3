"""Thirty-two metrics of trade by registry: what a nation ships, what it takes, and how whole orders went."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics, rank
from ..shared import save, table
from .registry import big, query, rounded

_IF = "sum(CASE WHEN {} THEN {} END)".format
#: The metrics (specification): key, numerator, denominator; 1 counts periods.
SHIPPED = (
    ("lines", "count(*)", "max(1)"), ("quantity", "sum(quantity)", "max(1)"), ("value", "sum(price)", "max(1)"), ("price_per_unit", "sum(price)", "sum(quantity)"), ("net_per_unit", "sum(price * (1 - discount))", "sum(quantity)"),
    ("quantity_per_line", "sum(quantity)", "count(*)"), ("discount_rate", "sum(price * discount)", "sum(price)"), ("tax_rate", "sum(price * tax)", "sum(price)"), ("tax_gap", "sum(tax - discount)", "count(*)"),
    ("return_rate", _IF("flag = 'R'", "quantity"), "sum(quantity)"), ("returned_lines", "count(CASE WHEN flag = 'R' THEN 1 END)", "count(*)"), ("returned_value", _IF("flag = 'R'", "price"), "sum(price)"), ("accepted_rate", _IF("flag = 'A'", "quantity"), "sum(quantity)"),
    ("open_rate", "count(CASE WHEN status = 'O' THEN 1 END)", "count(*)"), ("large_lines", "count(CASE WHEN quantity >= 40 THEN 1 END)", "count(*)"), ("small_lines", "coalesce(sum(CASE WHEN quantity <= 5 THEN 1 END), 0)", "max(1)"),
    ("delay", "sum(delay)", "count(*)"), ("late_rate", "count(CASE WHEN delay > 90 THEN 1 END)", "count(*)"),
)
TAKEN = (
    ("lines_taken", "count(*)", "max(1)"), ("value_taken", "sum(price)", "max(1)"), ("price_taken", "sum(price)", "sum(quantity)"), ("urgent_share", _IF("urgent = 1", "price"), "sum(price)"),
    ("discount_taken", "sum(price * discount)", "sum(price)"), ("deep_discounts", "count(CASE WHEN discount >= 0.08 THEN 1 END)", "count(*)"), ("returned_taken", _IF("flag = 'R'", "quantity"), "sum(quantity)"), ("suppliers", "count(DISTINCT supplier)", "max(1)"),
)
ORDERED = (
    ("orders", "count(*)", "max(1)"), ("lines_per_order", "sum(n)", "count(*)"), ("orders_with_return", "sum(returned)", "count(*)"), ("whole_orders_returned", "sum(CASE WHEN kept = 0 THEN 1 ELSE 0 END)", "count(*)"),
    ("orders_open", "sum(opened)", "count(*)"), ("large_orders", "count(CASE WHEN amount >= 100 THEN 1 END)", "count(*)"),
)
BRANCHES = (
    metrics.Branch("supply", "supply", SHIPPED),
    metrics.Branch("demand", "demand", TAKEN),
    metrics.Branch("order", "demand", ORDERED, "o_orderkey", {"n": "count(*)", "returned": "max(CASE WHEN flag = 'R' THEN 1 ELSE 0 END)", "kept": "max(CASE WHEN flag <> 'R' THEN 1 ELSE 0 END)", "opened": "max(CASE WHEN status = 'O' THEN 1 ELSE 0 END)", "amount": "sum(quantity)"}),
)
EVENTS = """
    trade AS (SELECT o_orderkey, s_nationkey::BIGINT AS supply, c_nationkey::BIGINT AS demand, (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS period, l_suppkey AS supplier, l_quantity AS quantity, l_extendedprice AS price,
                     l_discount AS discount, l_tax AS tax, l_returnflag AS flag, l_linestatus AS status, (o_orderpriority = '1-URGENT')::INT AS urgent, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS delay
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
METRIC_FACTS = f"{EVENTS}, metric_facts AS ({metrics.facts_sql('trade', BRANCHES)})"


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n, *c: table(spark, sf_dir, n).select(*c)
    orders = t("orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").join(t("customer", F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    lines = t("lineitem", F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    rows = lines.join(t("supplier", F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").join(orders, "o_orderkey")
    return rows.select(
        "o_orderkey", big(F.col("s_nationkey")).alias("supply"), big(F.col("c_nationkey")).alias("demand"), big(F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("period"), F.col("l_suppkey").alias("supplier"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"), F.datediff("l_shipdate", "o_orderdate").alias("delay"))


@query(f"WITH {METRIC_FACTS} SELECT unit, team, period, metric, round(numerator, 4) AS numerator, round(denominator, 4) AS denominator FROM metric_facts")
def metric_facts(spark, sf_dir):
    """Numerators and denominators of all thirty-two metrics by nation and month: one aggregate for each branch."""
    rows = metrics.all_facts(save(trade(spark, sf_dir), "trade"), BRANCHES)
    return rounded(rows, "numerator", "denominator", digits=4)


@query(f"""WITH {METRIC_FACTS},
    totals AS (SELECT unit, metric, team, sum(numerator) AS numerator, sum(denominator) AS denominator, count(*)::BIGINT AS periods FROM metric_facts GROUP BY 1, 2, 3 HAVING sum(denominator) > 0),
    rates AS (SELECT *, numerator / denominator AS rate, sum(numerator) OVER g / sum(denominator) OVER g AS league FROM totals WINDOW g AS (PARTITION BY unit, metric))
    SELECT unit, metric, team, periods, round(rate, 6) AS rate, round(CASE WHEN metric = 'tax_gap' THEN 1.0 ELSE rate / nullif(league, 0) END, 6) AS relative, (dense_rank() OVER (PARTITION BY unit, metric ORDER BY round(rate, 9) DESC))::BIGINT AS place FROM rates""")
def metric_board(spark, sf_dir):
    """Each metric's rate by nation as a ratio of sums, relative to all nations' (1 for the metric centred at zero), and its place."""
    rows = metrics.all_facts(save(trade(spark, sf_dir), "trade"), BRANCHES)
    totals = rows.groupBy("unit", "metric", "team").agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"), F.count(F.lit(1)).alias("periods")).filter("denominator > 0")
    own = Window.partitionBy("unit", "metric")  # a row for each nation
    rows = totals.withColumn("rate", F.col("numerator") / F.col("denominator")).withColumn("league", F.sum("numerator").over(own) / F.sum("denominator").over(own))
    relative = F.when(F.col("metric") == "tax_gap", 1.0).otherwise(F.col("rate") / F.nullif(F.col("league"), F.lit(0.0)))
    rows = rows.withColumn("relative", relative).withColumn("rank_rate", F.round("rate", 9)).withColumn("place", rank.dense_rank_desc("rank_rate", ["unit", "metric"]))
    return rounded(rows.select("unit", "metric", "team", "periods", "rate", "relative", "place"), "rate", "relative")
