"""The gate of a rating: does its fit beat the league's rate out of sample, and by which method is it told.

Every period is predicted from what was played strictly before it: by the league's rate, by a team's trailing rate shrunk
by its measured weight, and by the two-way ridge fit. Errors over all periods decide for each metric; then one ordered
choice gives every team its multiplier: pinned, pinned for want of signal, ridge, or shrunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import save
from . import aggregates, asof, fits, rank

#: Rows of a metric that can be calibrated, and rows before a period that is scored; pairs that measure a weight (fixed values).
LEAST_ROWS, LEAST_PAIRS = 400, 100
#: Trailing periods, games of prior weight, and what holds without calibration (fixed values).
WINDOW, PRIOR_GAMES, DEFAULT_PENALTY, DEFAULT_WEIGHT = 8, 6.0, 25.0, 0.3


def team_periods(cells: DataFrame) -> DataFrame:
    """(metric, team, period, numerator, denominator, trailing_n, trailing_d, full): each with the sums of the eight before it."""
    rows = cells.groupBy("metric", "team", "period").agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))
    before = asof.trailing(["metric", "team"], ["period"], WINDOW)
    return rows.withColumns({"trailing_n": F.sum("numerator").over(before), "trailing_d": F.sum("denominator").over(before), "full": F.count(F.lit(1)).over(before) == WINDOW})


def trailing_weight(teams: DataFrame) -> DataFrame:
    """(metric, beta, pairs): how much of a trailing rate's distance from the league's the next period keeps."""
    rows = teams.filter("full AND trailing_d > 0")
    league = rows.groupBy("metric").agg((F.sum("trailing_n") / F.sum("trailing_d")).alias("league")).filter("league != 0")
    rows = rows.join(league, "metric")
    x, y = F.col("trailing_n") / F.col("trailing_d") / F.col("league") - 1, F.col("numerator") / F.col("denominator") / F.col("league") - 1
    return rows.groupBy("metric").agg(aggregates.wls_origin(x, y, F.col("denominator"))["beta"].alias("beta"), F.count(F.lit(1)).alias("pairs"))


class Gate:
    """Calibration of every metric of ``games`` (metric, team, opponent, period, numerator, denominator), and multipliers as of the period after the last."""

    def __init__(self, games: DataFrame, penalties: Sequence[float], half_life: float = 17.0):
        self.cells = save(fits.usable(games), "gate-facts")
        self.teams = save(team_periods(self.cells), "gate-teams")
        places = save(fits.period_places(self.cells), "gate-periods")
        after = places.groupBy("metric").agg((F.max("cut") + 1).alias("cut"))
        self.after = save(after, "gate-after")
        scored = places.filter("k >= periods div 3").select("metric", "cut")
        self.sums = save(fits.aged_sums(self.cells, scored.unionByName(self.after), half_life), "gate-sums")
        penalties = sorted({*penalties, DEFAULT_PENALTY})
        self.fits = save(fits.ridge_fits(self.sums, penalties), "gate-fits")
        late = places.filter("k >= periods div 2").select("metric", "cut")
        self.calibration = save(self._calibration(late, scored), "gate-calibration")

    def _calibration(self, late: DataFrame, scored: DataFrame) -> DataFrame:
        """(metric, n, penalty, beta, ridge_gain, raw_gain): gains in percent of the league's squared error, null below ``LEAST_ROWS`` rows.
        The penalty is the best of the second half, the default where fewer than twice that many rows could choose."""
        size = self.cells.groupBy("metric").agg(F.sum("n").alias("n"))
        errors = fits.ridge_errors(self.cells, self.sums, self.fits, LEAST_ROWS).join(late, ["metric", "cut"], "left_semi")
        mse = errors.groupBy("metric", "penalty").agg((F.sum("error") / F.sum("weight")).alias("mse"))
        best = mse.groupBy("metric").agg(F.min_by("penalty", F.struct("mse", "penalty")).alias("best"))
        enough = F.col("n") >= 2 * LEAST_ROWS
        chosen = size.join(best, "metric", "left").withColumn("penalty", F.coalesce(F.when(enough, F.col("best")), F.lit(DEFAULT_PENALTY)))
        weight = trailing_weight(self.teams).select("metric", F.when(F.col("pairs") >= LEAST_PAIRS, F.col("beta")).alias("beta"))
        chosen = save(chosen.join(weight, "metric", "left").select("metric", "n", "penalty", F.coalesce("beta", F.lit(DEFAULT_WEIGHT)).alias("beta")), "gate-penalties")
        rows = fits.played(self.cells).join(scored, ["metric", "cut"], "left_semi").join(chosen, "metric")
        rows = rows.join(fits.leagues(self.sums).filter((F.col("seen") >= LEAST_ROWS) & (F.abs("league") >= 1e-12)), ["metric", "cut"])
        rows = rows.join(self.teams.select("metric", F.col("period").alias("cut"), "team", F.when(F.col("trailing_d") > 0, F.col("trailing_n") / F.col("trailing_d")).alias("rate")), ["metric", "cut", "team"])
        rows = rows.join(self.fits, ["metric", "cut", "penalty"], "left")
        league = F.col("league")
        raw = league * (1 + F.col("beta") * (F.coalesce("rate", league) / league - 1))
        ridge = F.coalesce(F.col("mean") + F.coalesce(F.try_element_at("rated", F.col("team")), F.lit(0.0)), league)
        total = rows.groupBy("metric").agg(*[F.sum(fits.squared_error(p)).alias(c) for c, p in (("base", league), ("raw", raw), ("ridge", ridge))])
        gain = lambda c: F.when(F.col("n") >= LEAST_ROWS, F.when(F.col("base") > 0, 100 * (1 - F.col(c) / F.col("base"))).otherwise(0.0))
        return chosen.join(total, "metric", "left").select("metric", "n", "penalty", "beta", gain("ridge").alias("ridge_gain"), gain("raw").alias("raw_gain"))

    def multipliers(self, additive: Sequence[str]) -> DataFrame:
        """(metric, team, raw_multiplier, multiplier, prior_games, method): ``additive`` metrics are pinned to 1, then those whose fit
        does not beat the league's rate; a fit gives (mean + effect) / mean; without one the trailing rate is shrunk.
        ``prior_games``: the games of prior weight that the multiplier amounts to."""
        recent = rank.top_k(self.teams.select("metric", "team", "period", "numerator", "denominator"), ["metric", "team"], [F.desc("period")], WINDOW)
        recent = recent.groupBy("metric", "team").agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"), F.count(F.lit(1)).alias("games"))
        own = Window.partitionBy("metric")  # a row for each team
        rows = recent.withColumn("league", F.sum("numerator").over(own) / F.sum("denominator").over(own)).withColumn("raw", F.col("numerator") / F.col("denominator"))
        rows = rows.join(self.calibration.select("metric", "penalty", "ridge_gain"), "metric")
        rows = rows.join(self.fits.join(self.after, ["metric", "cut"]).select("metric", "penalty", "mean", "rated"), ["metric", "penalty"], "left")
        pinned, silent, fitted = F.col("metric").isin(*additive), F.col("ridge_gain") <= 0, F.col("mean").isNotNull()
        method = F.when(pinned, "pinned").when(silent, "pinned:no_signal").when(fitted, "two_way_ridge").otherwise("shrunk_raw")
        ridge = F.when(F.col("mean") == 0, 1.0).otherwise((F.col("mean") + F.coalesce(F.try_element_at("rated", F.col("team")), F.lit(0.0))) / F.col("mean"))
        shrunk = rank.shrink_multiplier(F.col("games"), F.col("raw"), F.col("league"), PRIOR_GAMES)
        value = F.when(pinned | silent, 1.0).when(fitted, ridge).otherwise(shrunk)
        raw = F.when(pinned, 1.0).otherwise(F.coalesce(F.col("raw") / F.nullif(F.col("league"), F.lit(0.0)), F.lit(1.0)))
        rows = rows.select("metric", "team", "games", raw.alias("raw_multiplier"), value.alias("multiplier"), method.alias("method"))
        gap = F.col("raw_multiplier") - 1
        kept = F.when(F.abs(gap) > 1e-9, (F.col("multiplier") - 1) / gap)
        prior = F.when(F.col("method") == "two_way_ridge", F.when(kept > 1e-6, F.col("games") * (1 - kept) / kept)).when(F.col("method") == "shrunk_raw", F.lit(PRIOR_GAMES))
        return rows.select("metric", "team", "raw_multiplier", "multiplier", prior.alias("prior_games"), "method")
