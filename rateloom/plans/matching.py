"""Identity resolution: unique matches in a cascade, keep-first, keep-none, blanked ids, coalesced outer joins, name keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import aggregates, asof, reshape
from ..shared import table
from .registry import big, query


@query("""WITH l AS (SELECT c_custkey AS l_id, c_nationkey AS nation, round(c_acctbal)::BIGINT AS bal, c_custkey % 50 AS code FROM customer), r AS (SELECT s_suppkey AS r_id, s_nationkey AS nation, round(s_acctbal)::BIGINT AS bal, s_suppkey % 50 AS code FROM supplier),
    l1 AS (SELECT * FROM l QUALIFY count(*) OVER (PARTITION BY bal) = 1), r1 AS (SELECT * FROM r QUALIFY count(*) OVER (PARTITION BY bal) = 1), m1 AS (SELECT l_id, r_id, 'balance' AS matched_by FROM l1 JOIN r1 USING (bal)),
    l2 AS (SELECT * FROM l WHERE l_id NOT IN (SELECT l_id FROM m1) QUALIFY count(*) OVER (PARTITION BY nation, code) = 1), r2 AS (SELECT * FROM r WHERE r_id NOT IN (SELECT r_id FROM m1) QUALIFY count(*) OVER (PARTITION BY nation, code) = 1)
    SELECT * FROM m1 UNION ALL SELECT l_id, r_id, 'nation_code' FROM l2 JOIN r2 USING (nation, code)""")
def unique_match_cascade(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("l_id"), F.col("c_nationkey").alias("nation"), big(F.round("c_acctbal")).alias("bal"), (F.col("c_custkey") % 50).alias("code"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("r_id"), F.col("s_nationkey").alias("nation"), big(F.round("s_acctbal")).alias("bal"), (F.col("s_suppkey") % 50).alias("code"))
    pair = F.concat_ws("|", "nation", "code")
    return reshape.match_cascade(left, right, "l_id", "r_id", [("balance", F.col("bal").cast("string"), F.col("bal").cast("string")), ("nation_code", pair, pair)])


@query("""SELECT p_partkey, p_brand, CASE WHEN row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_retailprice DESC, p_partkey) = 1 THEN p_name || '/' || p_brand END AS label FROM part""")
def blank_ambiguous_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice", F.concat(F.col("p_name"), F.lit("/"), F.col("p_brand")).alias("label"))
    return reshape.blank_shared_ids(rows, ["label"], [F.desc("p_retailprice"), F.asc("p_partkey")]).select("p_partkey", "p_brand", "label")


@query("SELECT o_custkey, month, o_orderkey FROM (SELECT o_custkey, month(o_orderdate)::BIGINT AS month, o_orderkey, row_number() OVER (PARTITION BY o_custkey, month(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def dedup_keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", big(F.month("o_orderdate")).alias("month"), "o_orderkey", "o_totalprice")
    return asof.first_by(rows, ["o_custkey", "month"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).drop("o_totalprice")


@query("SELECT o_custkey, o_orderdate, o_orderkey FROM (SELECT o_custkey, o_orderdate, o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS n FROM orders) WHERE n = 1")
def dedup_keep_none(spark, sf_dir):
    return asof.only_unique(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey", "o_orderdate"])


@query("""SELECT coalesce(c.nation, s.nation)::BIGINT AS nation, coalesce(customers, 0)::BIGINT AS customers, coalesce(suppliers, 0)::BIGINT AS suppliers
    FROM (SELECT c_nationkey AS nation, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier GROUP BY 1) s ON c.nation = s.nation""")
def full_outer_coalesce(spark, sf_dir):
    left = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    right = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    rows = left.join(right, "nation", "full")
    return rows.select(big(F.col("nation")).alias("nation"), F.coalesce("customers", F.lit(0)).cast("long").alias("customers"), F.coalesce("suppliers", F.lit(0)).cast("long").alias("suppliers"))


@query("""SELECT field, filled::BIGINT AS filled, filled_active::BIGINT AS filled_active, round(filled * 1.0 / n, 6) AS rate, round(filled_active * 1.0 / m, 6) AS rate_active FROM (
    SELECT 'balance' AS field, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS filled, count(CASE WHEN c_acctbal > 0 AND c_nationkey < 10 THEN 1 END) AS filled_active, count(*) AS n, count(CASE WHEN c_nationkey < 10 THEN 1 END) AS m FROM customer
    UNION ALL SELECT 'segment', count(CASE WHEN c_mktsegment <> 'MACHINERY' THEN 1 END), count(CASE WHEN c_mktsegment <> 'MACHINERY' AND c_nationkey < 10 THEN 1 END), count(*), count(CASE WHEN c_nationkey < 10 THEN 1 END) FROM customer)""")
def fill_rate_report(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("segment"))
    out = aggregates.fill_rates(rows, ["balance", "segment"], F.col("c_nationkey") < 10)
    return out.select("field", "filled", "filled_active", F.round("rate", 6).alias("rate"), F.round("rate_active", 6).alias("rate_active"))


@query("""SELECT p_partkey, regexp_replace(trim(regexp_replace(lower(p_name || ' Jr.'), '[^a-z\\s]', '', 'g')), '\\s+(jr|sr|ii|iii|iv|v)$', '') || '|' || lower(p_type) AS key,
    regexp_replace(regexp_replace(trim(lower(p_brand || '.  x')), '\\.', '', 'g'), '\\s+', ' ', 'g') AS label FROM part""")
def name_key(spark, sf_dir):
    key = scalar.name_key(F.concat("p_name", F.lit(" Jr.")), F.lower("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("key"), scalar.label_key(F.concat("p_brand", F.lit(".  x"))).alias("label"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Full' WHEN 1 THEN 'DNP' WHEN 2 THEN 'Limited' ELSE 'Unknown' END AS status, (CASE WHEN p_size % 3 = 2 THEN NULL WHEN p_size % 3 = 1 THEN p_size ELSE 60 + p_size % 12 END)::BIGINT AS height FROM part""")
def status_and_height(spark, sf_dir):
    """Free text to a fixed vocabulary, and feet-and-inches to inches; what cannot be read is null."""
    four, three = F.col("p_size") % 4, F.col("p_size") % 3
    text = F.when(four == 0, "Full Participation in Practice").when(four == 1, "Did Not Participate In Practice").when(four == 2, "Limited Participation")
    height = F.when(three == 2, "tall").when(three == 1, F.col("p_size").cast("string")).otherwise(F.concat(F.lit("5'"), (F.col("p_size") % 12).cast("string"), F.lit('"')))
    return table(spark, sf_dir, "part").select("p_partkey", scalar.practice_status(text).alias("status"), big(scalar.height_inches(height)).alias("height"))


@query("""SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer WHERE lower(c_name) LIKE '%00012%' ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 12""")
def search_top(spark, sf_dir):
    """Case-insensitive substring search; the limit is the report's."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").filter(F.lower("c_name").contains("00012"))
    return rows.orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").limit(12).withColumn("c_acctbal", F.round("c_acctbal", 2))
