"""Filters, joins, projections, aggregates and sinks that other plans use in passing, each as a query of its own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import reshape
from ..shared import new_path, table
from ..sources.sinks import Table, overwrite_slices
from .registry import big, query, rounded


@query("""SELECT o_orderkey, CASE WHEN big AND odd THEN 'both' ELSE 'first' END AS source, CASE WHEN big AND odd THEN a2 ELSE a1 END AS a, CASE WHEN big AND odd THEN b2 ELSE b1 END AS b
    FROM (SELECT o_orderkey, o_totalprice > 100000 AS big, o_custkey % 2 = 1 AS odd, o_orderstatus AS a1, o_orderpriority AS b1, lower(o_orderstatus) AS a2, lower(o_orderpriority) AS b2 FROM orders)""")
def joint_override(spark, sf_dir):
    """Two columns of a second source take over only where it has both."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("a1"), F.col("o_orderpriority").alias("b1"), F.when(F.col("o_totalprice") > 100000, F.lower("o_orderstatus")).alias("a2"), F.when(F.col("o_custkey") % 2 == 1, F.lower("o_orderpriority")).alias("b2"))
    both = F.col("a2").isNotNull() & F.col("b2").isNotNull()
    return rows.select("o_orderkey", F.when(both, "both").otherwise("first").alias("source"), F.when(both, F.col("a2")).otherwise(F.col("a1")).alias("a"), F.when(both, F.col("b2")).otherwise(F.col("b1")).alias("b"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders) AND coalesce(o_orderpriority, '') <> '5-LOW'")
def latest_season_rows(spark, sf_dir):
    """A filter on a scalar subquery, and an inequality that keeps nulls."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").withColumn("season", F.year("o_orderdate"))
    newest = orders.agg(F.max("season").alias("season"))
    return orders.join(F.broadcast(newest), "season").filter(~F.col("o_orderpriority").eqNullSafe("5-LOW")).select("o_orderkey", "o_custkey")  # a single row


_SIDES = "sides AS (SELECT o_orderkey AS game, c_nationkey AS home, (c_nationkey + o_orderkey) % 25 AS away, o_totalprice / 1000 AS total, c_acctbal / 1000 AS spread FROM orders JOIN customer ON o_custkey = c_custkey)"


def pairings(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), big(F.col("c_nationkey")).alias("home"), (F.col("c_acctbal") / 1000).alias("spread"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(people, "o_custkey")
    return rows.select(F.col("o_orderkey").alias("game"), "home", ((F.col("home") + F.col("o_orderkey")) % 25).alias("away"), (F.col("o_totalprice") / 1000).alias("total"), "spread")


@query(f"WITH {_SIDES} SELECT game, home::BIGINT AS home, away::BIGINT AS away, round(total, 5) AS total FROM sides WHERE home = 7 OR away = 7")
def games_of_team(spark, sf_dir):
    """Either of two columns names the team."""
    return rounded(pairings(spark, sf_dir).filter("home = 7 OR away = 7").select("game", "home", "away", "total"), "total", digits=5)


@query(f"WITH {_SIDES} SELECT game, h.n_name AS home, a.n_name AS away FROM sides LEFT JOIN nation h ON home = h.n_nationkey LEFT JOIN nation a ON away = a.n_nationkey")
def pair_names(spark, sf_dir):
    """One dimension joined twice."""
    names = table(spark, sf_dir, "nation").select(big(F.col("n_nationkey")).alias("key"), "n_name")
    side = lambda x: names.select(F.col("key").alias(x), F.col("n_name").alias(f"{x}_name"))
    rows = pairings(spark, sf_dir).join(side("home"), "home", "left").join(side("away"), "away", "left")
    return rows.select("game", F.col("home_name").alias("home"), F.col("away_name").alias("away"))


@query(f"WITH {_SIDES} SELECT game, home::BIGINT AS team, away::BIGINT AS opponent, round(spread, 5) AS spread, true AS is_home FROM sides UNION ALL SELECT game, away, home, round(-spread, 5), false FROM sides")
def game_sides(spark, sf_dir):
    """One row for each side of a pairing, the line turned for the visitor."""
    rows = pairings(spark, sf_dir).withColumn("other", -F.col("spread"))
    out = reshape.sides(rows, ["game"], {"team": "home", "opponent": "away", "spread": "spread"}, {"team": "away", "opponent": "home", "spread": "other"})
    return rounded(out, "spread", digits=5)


@query("""SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS listed,
    c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS urgent FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)""")
def member_flags(spark, sf_dir):
    """A semi join, an anti join, and left joins to distinct keys as flags."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    keys = lambda rows: rows.select("c_custkey").distinct()
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(orders, "c_custkey", "left_semi").join(orders.filter("o_totalprice > 480000"), "c_custkey", "left_anti")
    rows = rows.join(keys(orders.filter("o_orderstatus = 'P'")).withColumn("p", F.lit(True)), "c_custkey", "left").join(keys(orders.filter("o_orderpriority = '1-URGENT'")).withColumn("u", F.lit(True)), "c_custkey", "left")
    return rows.select("c_custkey", (F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("p").isNotNull()).alias("listed"), F.col("u").isNotNull().alias("urgent"))


@query("""WITH gated AS (SELECT c_nationkey FROM customer GROUP BY 1 HAVING avg(c_acctbal) >= 0 AND count(*) >= 2)
    SELECT s_suppkey, coalesce(factor, 1.0) AS factor FROM supplier JOIN gated ON s_nationkey = c_nationkey
    LEFT JOIN (VALUES ('AFRICA', 1.1), ('ASIA', 0.9)) v(region, factor) ON region = (SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = s_nationkey)""")
def gated_lookup(spark, sf_dir):
    """Rows of groups that pass a gate, with a factor from a small map; 1 where the map has none."""
    gate = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.avg("c_acctbal").alias("m"), F.count(F.lit(1)).alias("n")).filter("m >= 0 AND n >= 2")
    names = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), "r_name")
    factor = F.create_map(F.lit("AFRICA"), F.lit(1.1), F.lit("ASIA"), F.lit(0.9))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(gate, "s_nationkey", "left_semi").join(names, "s_nationkey", "left")
    return rows.select("s_suppkey", F.coalesce(F.try_element_at(factor, F.col("r_name")), F.lit(1.0)).alias("factor"))


_BRANCHES = {"n_orders": ("count(*)", "1 = 1"), "urgent": ("count(*)", "o_orderpriority = '1-URGENT'"), "open": ("count(*)", "o_orderstatus = 'O'"), "done": ("count(*)", "o_orderstatus = 'F'"),
             "spent": ("round(sum(o_totalprice), 2)", "1 = 1"), "largest": ("max(o_totalprice)", "1 = 1"), "first_season": ("min(year(o_orderdate))", "1 = 1"), "last_season": ("max(year(o_orderdate))", "1 = 1")}


@query("SELECT c_custkey, " + ", ".join(f"b{k}.v AS {n}" for k, n in enumerate(_BRANCHES)) + " FROM customer " + " ".join(
    f"LEFT JOIN (SELECT o_custkey, {v} AS v FROM orders WHERE {w} GROUP BY 1) b{k} ON b{k}.o_custkey = c_custkey" for k, (v, w) in enumerate(_BRANCHES.values())))
def entity_star(spark, sf_dir):
    """Eight branches of one table joined to their entity: conditional aggregates give them in one pass and one join."""
    n = lambda cond: F.nullif(F.count_if(cond), F.lit(0).cast("long"))
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), n(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), n(F.col("o_orderstatus") == "O").alias("open"), n(F.col("o_orderstatus") == "F").alias("done"),
        F.round(F.sum("o_totalprice"), 2).alias("spent"), F.max("o_totalprice").alias("largest"), big(F.min(F.year("o_orderdate"))).alias("first_season"), big(F.max(F.year("o_orderdate"))).alias("last_season"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(own, "c_custkey", "left")


@query("""WITH cells AS (SELECT l_shipmode_ AS band, l_linestatus, avg(l_extendedprice) AS m, count(*) AS n, any_value(l_returnflag) FILTER (l_returnflag = 'R') AS flag
                         FROM (SELECT *, floor(l_quantity / 10)::BIGINT AS l_shipmode_ FROM lineitem) GROUP BY 1, 2)
    SELECT band, round(sum(m * n) / sum(n), 4) AS mean, sum(n)::BIGINT AS n, any_value(flag) AS flag FROM cells GROUP BY 1""")
def reaggregated_means(spark, sf_dir):
    """Means of stored cells weighted by their counts; any value that is not null."""
    cells = table(spark, sf_dir, "lineitem").groupBy(big(F.floor(F.col("l_quantity") / 10)).alias("band"), "l_linestatus").agg(
        F.avg("l_extendedprice").alias("m"), F.count(F.lit(1)).alias("n"), F.any_value(F.when(F.col("l_returnflag") == "R", F.col("l_returnflag")), F.lit(True)).alias("flag"))
    return cells.groupBy("band").agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 4).alias("mean"), F.sum("n").alias("n"), F.any_value("flag", F.lit(True)).alias("flag"))


@query("""WITH cells AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer GROUP BY 1, 2)
    SELECT c_mktsegment, round(sum(n * m) FILTER (s > 0) / sum(n) FILTER (s > 0), 4) AS mean, sum(n) FILTER (s > 0)::BIGINT AS n, count(*)::BIGINT AS cells FROM cells GROUP BY 1""")
def nondegenerate_mean(spark, sf_dir):
    """A mean over cells that vary, weighted by their counts."""
    cells = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("m"), F.stddev_samp("c_acctbal").alias("s"))
    n = F.when(F.col("s") > 0, F.col("n"))
    return cells.groupBy("c_mktsegment").agg(F.round(F.sum(n * F.col("m")) / F.sum(n), 4).alias("mean"), F.sum(n).alias("n"), F.count(F.lit(1)).alias("cells"))


@query("""SELECT p_partkey, p_brand, p_size::BIGINT AS p_size, TRY_CAST(split_part(p_type, ' ', 2) AS BIGINT) AS grade, NULL::DOUBLE AS weight, p_retailprice AS price FROM part""")
def tolerant_reads(spark, sf_dir):
    """Columns read as a type whatever they hold, null where the column is absent, and a rename only where the name is free."""
    part = table(spark, sf_dir, "part").withColumn("second", F.get(F.split("p_type", " "), F.lit(1)))
    rows = reshape.rename_guarded(part, {"p_retailprice": "price", "p_name": "p_brand"})
    return rows.select("p_partkey", "p_brand", reshape.tolerant(rows, "p_size", "long").alias("p_size"), reshape.tolerant(rows, "second", "long").alias("grade"), reshape.tolerant(rows, "weight", "double").alias("weight"), "price")


@query("""WITH early AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) <= 1996), late AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) >= 1999)
    SELECT o_custkey, 'gone' AS state FROM (SELECT * FROM early EXCEPT SELECT * FROM late) UNION ALL SELECT o_custkey, 'new' FROM (SELECT * FROM late EXCEPT SELECT * FROM early)
    UNION ALL SELECT o_custkey, 'stayed' FROM (SELECT * FROM early INTERSECT SELECT * FROM late)""")
def id_sets(spark, sf_dir):
    """Difference both ways and intersection of two sets of identifiers, from one aggregate."""
    season = F.year("o_orderdate")
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(season <= 1996).alias("early"), F.bool_or(season >= 1999).alias("late")).filter("early OR late")
    return rows.select("o_custkey", F.when(F.col("early") & F.col("late"), "stayed").when(F.col("early"), "gone").otherwise("new").alias("state"))


@query("""SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_run(spark, sf_dir):
    """The last row of every key, as a partial aggregate."""
    rows = table(spark, sf_dir, "events")
    last = F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id"))
    return rows.groupBy("user_id").agg(last.alias("x")).select("user_id", "x.event_type", "x.event_id")


_STEPS = """stored AS (SELECT c_custkey, c_acctbal AS balance, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 < 2),
    changes AS (SELECT c_custkey, c_acctbal + 1 AS balance, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 > 0)"""


@query(f"WITH {_STEPS} SELECT c_custkey, round(balance, 2) AS balance, segment FROM (SELECT * FROM changes UNION ALL SELECT * FROM stored WHERE c_custkey NOT IN (SELECT c_custkey FROM changes))")
def sink_upsert(spark, sf_dir):
    """A stored table after an upsert."""
    stored, changes = _steps(spark, sf_dir)
    out = Table(spark, new_path(spark, "sink-upsert"))
    out.replace(stored)
    out.upsert(changes, ["c_custkey"])
    return rounded(out.read(), "balance", digits=2)


@query(f"WITH {_STEPS} SELECT c_custkey, round(balance, 2) AS balance, segment FROM (SELECT * FROM stored UNION ALL SELECT * FROM changes WHERE c_custkey NOT IN (SELECT c_custkey FROM stored))")
def sink_insert_ignore(spark, sf_dir):
    """A stored table after an insert that leaves known keys alone."""
    stored, changes = _steps(spark, sf_dir)
    out = Table(spark, new_path(spark, "sink-ignore"))
    out.replace(stored)
    out.insert_ignore(changes, ["c_custkey"])
    return rounded(out.read(), "balance", digits=2)


@query(f"WITH {_STEPS} SELECT c_custkey, round(balance, 2) AS balance, segment FROM (SELECT * FROM stored UNION ALL SELECT * FROM changes)")
def sink_append(spark, sf_dir):
    """A stored table after an append."""
    stored, changes = _steps(spark, sf_dir)
    out = Table(spark, new_path(spark, "sink-append"))
    out.append(stored)
    out.append(changes)
    return rounded(out.read(), "balance", digits=2)


@query(f"""WITH {_STEPS} SELECT c_custkey, round(balance, 2) AS balance, segment FROM (SELECT * FROM changes WHERE segment = 'BUILDING' UNION ALL SELECT * FROM stored WHERE segment <> 'BUILDING' OR NOT EXISTS (SELECT 1 FROM changes WHERE segment = 'BUILDING'))""")
def sink_slices(spark, sf_dir):
    """A partitioned table after one of its slices was replaced."""
    stored, changes = _steps(spark, sf_dir)
    path = new_path(spark, "sink-slices")
    overwrite_slices(stored, path, ["segment"])
    overwrite_slices(changes.filter("segment = 'BUILDING'"), path, ["segment"])
    return rounded(spark.read.parquet(path).select("c_custkey", "balance", "segment"), "balance", digits=2)


def _steps(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return rows.filter("c_custkey % 3 < 2"), rows.filter("c_custkey % 3 > 0").withColumn("balance", F.col("balance") + 1)


@query("SELECT o_custkey, o_orderkey, round(o_totalprice - lag(o_totalprice) OVER w, 2) AS change FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def change_since_last(spark, sf_dir):
    """Difference to the entity's row before."""
    before = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(before), 2).alias("change"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, epoch(try_strptime(strftime(o_orderdate, '%Y-%m-%d') || ' ' || clock, '%Y-%m-%d %H:%M'))::BIGINT AS kickoff,
        round((epoch(TIMESTAMP '2002-01-01') - epoch(o_orderdate)) / 3600.0, 3) AS age_hours, (year(o_orderdate) - (month(o_orderdate) < 3)::INT)::BIGINT AS season
    FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 'late' ELSE lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':30' END AS clock FROM orders)""")
def clock_and_season(spark, sf_dir):
    """A date and a clock text to a time (null where the clock cannot be read), the age in hours, and the season, which starts in March."""
    clock = F.when(F.col("o_orderkey") % 5 == 0, "late").otherwise(F.concat(F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":30")))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    at = F.try_to_timestamp(F.concat_ws(" ", day, clock), F.lit("yyyy-MM-dd HH:mm"))
    age = (F.unix_timestamp(F.lit("2002-01-01 00:00:00").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))) / 3600
    season = F.year("o_orderdate") - (F.month("o_orderdate") < 3).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), F.unix_seconds(at).alias("kickoff"), F.round(age, 3).alias("age_hours"), big(season).alias("season"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN '+' ELSE '-' END || abs(round(c_acctbal))::BIGINT AS signed, round(100 * p)::BIGINT || '%' AS percent,
        CASE WHEN p >= 0.5 THEN -round(100 * p / (1 - p)) ELSE round(100 * (1 - p) / p) END::BIGINT AS odds,
        CASE WHEN h < 1 THEN 'now' WHEN h < 24 THEN h || 'h ago' ELSE h // 24 || 'd ago' END AS seen
    FROM (SELECT *, 0.05 + 0.9 * ((c_custkey * 37) % 101) / 101.0 AS p, (c_custkey % 72)::BIGINT AS h FROM customer)""")
def display_formats(spark, sf_dir):
    """Signed numbers, percents, odds as their American figures, and times as ages."""
    p, h = 0.05 + 0.9 * ((F.col("c_custkey") * 37) % 101) / 101.0, F.col("c_custkey") % 72
    odds = F.when(p >= 0.5, -F.round(100 * p / (1 - p))).otherwise(F.round(100 * (1 - p) / p))
    seen = F.when(h < 1, "now").when(h < 24, F.concat(h.cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(h / 24).cast("string"), F.lit("d ago")))
    signed = F.concat(F.when(F.col("c_acctbal") >= 0, "+").otherwise("-"), F.abs(F.round("c_acctbal")).cast("long").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", signed.alias("signed"), F.concat(F.round(100 * p).cast("long").cast("string"), F.lit("%")).alias("percent"), odds.cast("long").alias("odds"), seen.alias("seen"))


@query("""WITH bounds AS (SELECT event_type, min(value) AS low, max(value) AS high FROM events GROUP BY 1)
    SELECT event_type, least(19, floor((value - low) / nullif(high - low, 0) * 20))::BIGINT AS bin, count(*)::BIGINT AS n, round(min(value), 6) AS least, round(max(value), 6) AS largest FROM events JOIN bounds USING (event_type) GROUP BY 1, 2""")
def value_histogram(spark, sf_dir):
    """Twenty equal bins between each group's extremes."""
    rows = table(spark, sf_dir, "events").select("event_type", "value")
    bounds = rows.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    place = F.floor((F.col("value") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * 20)
    rows = rows.join(bounds, "event_type").groupBy("event_type", F.least(F.lit(19).cast("long"), place).alias("bin"))
    return rounded(rows.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("largest")), "least", "largest")
