"""Walk-forward calibration of counterparty ratings and the method that it chooses (see ``operators.gate``).

The metrics are chosen so that every method occurs: ``tax_gap`` is centred near zero and is not divided by; a nation's own
trade has few teams, so that no fit is made; monthly lines differ by nation and counterparty, prices hardly do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fits, gate, reshape
from ..shared import importable
from . import ratings
from .registry import query, rounded

PENALTIES, ADDITIVE = (5.0, 25.0, 100.0, 400.0), ("tax_gap",)

GATE_FACTS = """
    gate_base AS (
        SELECT s_nationkey::BIGINT AS team, c_nationkey::BIGINT AS opponent, (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS period, sum(l_extendedprice * (1 - l_discount)) AS revenue,
               sum(l_quantity) AS quantity, sum(l_tax - l_discount) AS gap, count(*)::DOUBLE AS lines
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
    gate_facts AS (
        SELECT 'net_price' AS metric, team, opponent, period, revenue AS numerator, quantity AS denominator FROM gate_base
        UNION ALL SELECT 'lines', team, opponent, period, lines, 1.0 FROM gate_base
        UNION ALL SELECT 'tax_gap', team, opponent, period, gap, lines FROM gate_base
        UNION ALL SELECT 'own_lines', team, opponent, period, lines, 1.0 FROM gate_base WHERE team = opponent AND team < 4),
    cells AS (SELECT * FROM gate_facts WHERE denominator > 0 AND numerator IS NOT NULL),
    places AS (SELECT metric, period AS cut, row_number() OVER (PARTITION BY metric ORDER BY period) - 1 AS k, count(*) OVER (PARTITION BY metric) AS periods FROM (SELECT DISTINCT metric, period FROM cells)),
    cuts AS (SELECT metric, cut, k >= periods // 2 AS late, true AS scored FROM places WHERE k >= periods // 3 UNION ALL SELECT metric, max(period) + 1, false, false FROM cells GROUP BY 1)"""


def walk_sql(penalties) -> str:
    """Fits before every cut by block Gauss-Seidel: faced effects, rated effects (both centred), the mean; sixteen rounds."""
    return f"""
    sums AS (SELECT metric, cut, team, opponent, sum(denominator * 0.5 ** ((cut - period) / 17.0)) AS w, sum(numerator * 0.5 ** ((cut - period) / 17.0)) AS wy, count(*) AS n, sum(numerator) AS num, sum(denominator) AS den
             FROM cells JOIN cuts USING (metric) WHERE period < cut GROUP BY 1, 2, 3, 4),
    size AS (SELECT metric, cut, sum(n)::BIGINT AS seen, count(DISTINCT team) AS teams, sum(n) / sum(w) AS scale, sum(num) / sum(den) AS league FROM sums GROUP BY 1, 2),
    pairs AS (SELECT metric, cut, team, opponent, w * scale AS w, wy * scale AS wy FROM sums JOIN size USING (metric, cut) WHERE seen >= 32 AND teams >= 8),
    it AS (SELECT 0 AS k, metric, cut, penalty, team, 0.0::DOUBLE AS r, 0.0::DOUBLE AS f, 0.0::DOUBLE AS mu FROM (SELECT metric, cut, team FROM pairs UNION SELECT metric, cut, opponent FROM pairs), (SELECT unnest([{", ".join(map(str, penalties))}])::DOUBLE AS penalty)
        UNION ALL
        (WITH now AS (SELECT * FROM it),
         f1 AS (SELECT p.metric, p.cut, penalty, opponent AS team, sum(wy - w * (mu + r)) / (sum(w) + penalty) AS f FROM pairs p JOIN now ON now.metric = p.metric AND now.cut = p.cut AND now.team = p.team GROUP BY 1, 2, 3, 4),
         f2 AS (SELECT now.metric, now.cut, now.penalty, now.team, coalesce(f1.f, 0) - avg(coalesce(f1.f, 0)) OVER (PARTITION BY now.metric, now.cut, now.penalty) AS f FROM now LEFT JOIN f1 USING (metric, cut, penalty, team)),
         r1 AS (SELECT p.metric, p.cut, now.penalty, p.team, sum(wy - w * (mu + f2.f)) / (sum(w) + now.penalty) AS r FROM pairs p JOIN f2 ON f2.metric = p.metric AND f2.cut = p.cut AND f2.team = opponent
                JOIN now ON now.metric = p.metric AND now.cut = p.cut AND now.team = p.team AND now.penalty = f2.penalty GROUP BY 1, 2, 3, 4),
         r2 AS (SELECT now.metric, now.cut, now.penalty, now.team, k, coalesce(r1.r, 0) - avg(coalesce(r1.r, 0)) OVER (PARTITION BY now.metric, now.cut, now.penalty) AS r FROM now LEFT JOIN r1 USING (metric, cut, penalty, team)),
         m2 AS (SELECT p.metric, p.cut, r2.penalty, sum(wy - w * (r2.r + f2.f)) / sum(w) AS mu FROM pairs p JOIN f2 ON f2.metric = p.metric AND f2.cut = p.cut AND f2.team = opponent
                JOIN r2 ON r2.metric = p.metric AND r2.cut = p.cut AND r2.team = p.team AND r2.penalty = f2.penalty GROUP BY 1, 2, 3)
         SELECT k + 1, r2.metric, r2.cut, r2.penalty, r2.team, r2.r, f2.f, m2.mu FROM r2 JOIN f2 USING (metric, cut, penalty, team) JOIN m2 USING (metric, cut, penalty) WHERE k < 16)),
    fits AS (SELECT metric, cut, penalty, team, mu + r AS predicted, mu AS mean FROM it WHERE k = 16),
    means AS (SELECT metric, cut, penalty, any_value(mean) AS mean FROM fits GROUP BY 1, 2, 3),
    played AS (SELECT metric, period AS cut, team, sum(denominator) AS w, sum(numerator) AS y, sum(numerator * numerator / denominator) AS yy FROM cells GROUP BY 1, 2, 3),
    scored AS (SELECT p.*, penalty, league, late, coalesce(predicted, means.mean) AS p FROM played p JOIN cuts USING (metric, cut) JOIN size USING (metric, cut) JOIN means USING (metric, cut) LEFT JOIN fits USING (metric, cut, penalty, team))"""


GATE_SQL = f"""WITH RECURSIVE {GATE_FACTS}, {walk_sql(PENALTIES)},
    mse AS (SELECT metric, penalty, sum(yy - 2 * p * y + p * p * w) / sum(w) AS mse FROM scored JOIN size USING (metric, cut) WHERE late AND seen >= 400 GROUP BY 1, 2),
    best AS (SELECT metric, arg_min(penalty, (mse, penalty)) AS best FROM mse GROUP BY 1),
    teams AS (SELECT *, sum(numerator) OVER w AS n8, sum(denominator) OVER w AS d8, count(*) OVER w AS k8 FROM (SELECT metric, team, period, sum(numerator) AS numerator, sum(denominator) AS denominator FROM cells GROUP BY 1, 2, 3)
              WINDOW w AS (PARTITION BY metric, team ORDER BY period ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
    whole AS (SELECT metric, sum(n8) / sum(d8) AS whole FROM teams WHERE k8 = 8 AND d8 > 0 GROUP BY 1),
    slopes AS (SELECT metric, count(*) AS pairs, greatest(0.0, least(1.0, sum(denominator * x * y) / nullif(sum(denominator * x * x), 0))) AS beta FROM (SELECT metric, denominator, n8 / d8 / whole - 1 AS x, numerator / denominator / whole - 1 AS y FROM teams JOIN whole USING (metric) WHERE k8 = 8 AND d8 > 0 AND whole <> 0) GROUP BY 1),
    chosen AS (SELECT metric, n, CASE WHEN n >= 800 THEN coalesce(best, 25.0) ELSE 25.0 END AS penalty, coalesce(CASE WHEN pairs >= 100 THEN beta END, 0.3) AS beta FROM (SELECT metric, count(*)::BIGINT AS n FROM cells GROUP BY 1) LEFT JOIN best USING (metric) LEFT JOIN slopes USING (metric)),
    rows AS (SELECT p.metric, w, y, yy, league, league * (1 + beta * (coalesce(CASE WHEN d8 > 0 THEN n8 / d8 END, league) / league - 1)) AS raw, coalesce(predicted, means.mean, league) AS ridge
             FROM played p JOIN cuts USING (metric, cut) JOIN size USING (metric, cut) JOIN chosen USING (metric) JOIN teams ON teams.metric = p.metric AND teams.period = p.cut AND teams.team = p.team
             LEFT JOIN means ON means.metric = p.metric AND means.cut = p.cut AND means.penalty = chosen.penalty LEFT JOIN fits ON fits.metric = p.metric AND fits.cut = p.cut AND fits.penalty = chosen.penalty AND fits.team = p.team
             WHERE scored AND seen >= 400 AND abs(league) >= 1e-12),
    errors AS (SELECT metric, sum(yy - 2 * league * y + league * league * w) AS base, sum(yy - 2 * raw * y + raw * raw * w) AS raw, sum(yy - 2 * ridge * y + ridge * ridge * w) AS ridge FROM rows GROUP BY 1),
    gated AS (SELECT metric, n, penalty, beta, CASE WHEN n >= 400 THEN CASE WHEN base > 0 THEN 100 * (1 - ridge / base) ELSE 0 END END AS ridge_gain, CASE WHEN n >= 400 THEN CASE WHEN base > 0 THEN 100 * (1 - raw / base) ELSE 0 END END AS raw_gain FROM chosen LEFT JOIN errors USING (metric))"""


def gate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ratings.star(spark, sf_dir).groupBy("team", "opponent", "period").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.sum("l_quantity").alias("quantity"), F.sum(F.col("l_tax") - F.col("l_discount")).alias("gap"), F.count(F.lit(1)).cast("double").alias("lines"))
    own = (F.col("team") == F.col("opponent")) & (F.col("team") < 4)
    pairs = {"net_price": (F.col("revenue"), F.col("quantity")), "lines": (F.col("lines"), F.lit(1.0)), "tax_gap": (F.col("gap"), F.col("lines")), "own_lines": (F.when(own, F.col("lines")), F.lit(1.0))}
    return reshape.unpivot_pairs(base, ["team", "opponent", "period"], pairs)


@query(f"{GATE_SQL} SELECT metric, n, penalty, round(beta, 5) AS beta, round(ridge_gain, 3) AS ridge_gain, round(raw_gain, 3) AS raw_gain FROM gated")
def rating_gate(spark, sf_dir):
    """For each metric the best penalty, and what the fit and the shrunk trailing rate take off the league's squared error."""
    importable(spark)
    rows = gate.Gate(gate_facts(spark, sf_dir), PENALTIES).calibration
    return rounded(rounded(rows, "beta", digits=5), "ridge_gain", "raw_gain", digits=3)


@query(f"""{GATE_SQL},
    recent AS (SELECT metric, team, sum(numerator) / sum(denominator) AS raw, count(*) AS games, sum(numerator) AS s, sum(denominator) AS d FROM (SELECT *, row_number() OVER (PARTITION BY metric, team ORDER BY period DESC) AS ago FROM teams) WHERE ago <= 8 GROUP BY 1, 2),
    rated AS (SELECT *, sum(s) OVER (PARTITION BY metric) / sum(d) OVER (PARTITION BY metric) AS whole8 FROM recent),
    last AS (SELECT f.* FROM fits f JOIN cuts USING (metric, cut) JOIN chosen USING (metric) WHERE NOT scored AND f.penalty = chosen.penalty),
    final AS (SELECT r.metric, r.team, games, CASE WHEN r.metric = 'tax_gap' THEN 1.0 ELSE raw / whole8 END AS raw_multiplier,
                     CASE WHEN r.metric = 'tax_gap' OR ridge_gain <= 0 THEN 1.0 WHEN mean IS NOT NULL THEN predicted / mean ELSE (games * raw + 6.0 * whole8) / (games + 6.0) / whole8 END AS multiplier,
                     CASE WHEN r.metric = 'tax_gap' THEN 'pinned' WHEN ridge_gain <= 0 THEN 'pinned:no_signal' WHEN mean IS NOT NULL THEN 'two_way_ridge' ELSE 'shrunk_raw' END AS method
              FROM rated r JOIN gated USING (metric) LEFT JOIN last ON last.metric = r.metric AND last.team = r.team)
    SELECT metric, team, round(raw_multiplier, 6) AS raw_multiplier, round(multiplier, 6) AS multiplier, method,
           round(CASE method WHEN 'shrunk_raw' THEN 6.0 WHEN 'two_way_ridge' THEN CASE WHEN abs(raw_multiplier - 1) > 1e-9 AND (multiplier - 1) / (raw_multiplier - 1) > 1e-6 THEN games * (1 - (multiplier - 1) / (raw_multiplier - 1)) / ((multiplier - 1) / (raw_multiplier - 1)) END END, 3) AS prior_games FROM final""")
def multiplier_gated(spark, sf_dir):
    """Multipliers as of the period after the last one, each by the method that the gate chooses."""
    importable(spark)
    rows = gate.Gate(gate_facts(spark, sf_dir), PENALTIES).multipliers(ADDITIVE)
    return rounded(rounded(rows, "raw_multiplier", "multiplier"), "prior_games", digits=3)


@query(f"""WITH RECURSIVE {GATE_FACTS.replace("UNION ALL SELECT 'tax_gap'", "UNION ALL SELECT 'return_rate', team, opponent, period, returned, quantity FROM gate_base WHERE returned IS NOT NULL UNION ALL SELECT 'tax_gap'").replace("count(*)::DOUBLE AS lines", "count(*)::DOUBLE AS lines, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS returned").replace("FROM gate_facts WHERE", "FROM gate_facts WHERE metric IN ('net_price', 'return_rate', 'lines') AND")}, {walk_sql((1.0, 5.0, 25.0, 100.0))},
    mse AS (SELECT metric, penalty, sum(yy - 2 * p * y + p * p * w) / sum(w) AS mse, sum(yy - 2 * s.league * y + s.league * s.league * w) / sum(w) AS baseline_mse FROM scored s JOIN size USING (metric, cut) WHERE late AND seen >= 100 GROUP BY 1, 2)
    SELECT metric, arg_min(penalty, (mse, penalty)) AS penalty, round(min(mse), 3) AS mse, round(arg_min(baseline_mse, (mse, penalty)), 3) AS baseline_mse, round(min(mse) / arg_min(baseline_mse, (mse, penalty)), 6) AS relative FROM mse GROUP BY 1""")
def ridge_tuning(spark, sf_dir):
    """Walk-forward error of each penalty, and the best (the first of equals) of each metric."""
    importable(spark)
    errors = fits.tune_ridge(ratings.facts(spark, sf_dir), [1.0, 5.0, 25.0, 100.0])
    best = errors.groupBy("metric").agg(F.min_by(F.struct("penalty", "mse", "baseline_mse"), F.struct("mse", "penalty")).alias("best")).select("metric", "best.*")
    return rounded(rounded(best.withColumn("relative", F.col("mse") / F.col("baseline_mse")), "relative"), "mse", "baseline_mse", digits=3)
