"""Model fits: two-way ridge and its tuning, least squares from sums, logistic Newton, simulation.

Rows are reduced to sufficient statistics, or grouped by (unit, metric), before Python sees them: a group holds one
metric's facts for one unit kind, whose number is bounded by teams times periods and does not grow with the raw events.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import save

LEAST_ROWS, LEAST_TEAMS = 32, 8


def ridge_effects(cells: pd.DataFrame, penalties: Sequence[float]) -> list[tuple[float, dict, dict]] | None:
    """rate = mean + rated effect + faced effect, weighted by volume and recency; only effects are penalised, and both sets
    are centred. ``cells``: (team, opponent, w, wy, n), the sums of weights, weighted rates and rows. One fit for each penalty; None
    where there are too few rows or teams."""
    if cells["n"].sum() < LEAST_ROWS or cells["team"].nunique() < LEAST_TEAMS:
        return None
    cells = cells.sort_values(["team", "opponent"])
    teams = sorted(set(cells["team"]) | set(cells["opponent"]))
    number = {t: k for k, t in enumerate(teams)}
    n, scale = len(teams), cells["n"].sum() / cells["w"].sum()
    index = np.stack([np.zeros(len(cells), int), 1 + cells["team"].map(number).to_numpy(), 1 + n + cells["opponent"].map(number).to_numpy()])
    w, wy = cells["w"].to_numpy() * scale, cells["wy"].to_numpy() * scale
    gram, right, out = np.zeros((2 * n + 1, 2 * n + 1)), np.zeros(2 * n + 1), []
    for a in range(3):
        np.add.at(right, index[a], wy)
        for b in range(3):
            np.add.at(gram, (index[a], index[b]), w)
    for penalty in penalties:
        mean, effects = (s := np.linalg.solve(gram + np.diag([0.0] + [penalty] * (2 * n)), right))[0], s[1:]
        rated, faced = effects[:n], effects[n:]
        mean, rated, faced = mean + rated.mean() + faced.mean(), rated - rated.mean(), faced - faced.mean()
        out.append((float(mean), dict(zip(teams, rated.tolist())), dict(zip(teams, faced.tolist()))))
    return out


def weighted_cells(games: DataFrame, keys: Sequence[str], half_life: float) -> DataFrame:
    """(keys, team, opponent, w, wy, n, numerator, denominator): what a fit needs of rows (numerator, denominator, games_ago); the volume
    cancels in the weighted rate. Rows without volume or numerator are left out."""
    w = F.pow(F.lit(0.5), F.col("games_ago") / half_life)
    rows = games.filter("denominator > 0 AND numerator IS NOT NULL")
    return rows.groupBy(*keys, "team", "opponent").agg(
        F.sum(F.col("denominator") * w).alias("w"), F.sum(F.col("numerator") * w).alias("wy"), F.count(F.lit(1)).alias("n"), F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))


def two_way_ridge(games: DataFrame, penalty: float = 25.0, half_life: float = 17.0) -> DataFrame:
    """(metric, team, mean, rated, faced) from (metric, team, opponent, numerator, denominator, games_ago), one fit a metric.
    Spark sums the rows; a fit reads a row for each pair of teams."""

    def fit(cells: pd.DataFrame) -> pd.DataFrame:
        found = ridge_effects(cells, [penalty])
        columns = ["metric", "team", "mean", "rated", "faced"]
        if not found:
            return pd.DataFrame({c: [] for c in columns})
        mean, rated, faced = found[0]
        return pd.DataFrame([(cells["metric"].iloc[0], t, mean, rated[t], faced[t]) for t in rated], columns=columns)

    return weighted_cells(games, ["metric"], half_life).groupBy("metric").applyInPandas(fit, "metric string, team long, mean double, rated double, faced double")


def usable(games: DataFrame) -> DataFrame:
    """(metric, team, opponent, period, numerator, denominator, n): sums of the rows that a fit may read."""
    rows = games.filter("denominator > 0 AND numerator IS NOT NULL AND team IS NOT NULL AND opponent IS NOT NULL AND period IS NOT NULL")
    return rows.groupBy("metric", "team", "opponent", "period").agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"), F.count(F.lit(1)).alias("n"))


def period_places(cells: DataFrame) -> DataFrame:
    """(metric, cut, k, periods): the periods of each metric with their place from 0."""
    own = Window.partitionBy("metric")
    rows = cells.select("metric", F.col("period").alias("cut")).distinct()
    return rows.withColumns({"k": F.row_number().over(own.orderBy("cut")) - 1, "periods": F.count(F.lit(1)).over(own)})


def aged_sums(cells: DataFrame, cuts: DataFrame, half_life: float = 17.0) -> DataFrame:
    """(metric, cut, team, opponent, w, wy, n, numerator, denominator): what a fit before each cut needs of all ``cells``
    (see ``usable``) strictly before it, weighted by volume and age.

    Sums age: from one cut to the next a pair's sums shrink by the age between them, and what was played since is added. Rows
    are never met with later cuts: each pair's history and the cuts after its first row are sorted once, and running sums,
    scaled by the age up to the last cut, are read at the cuts. (Ages of over 1,000 half-lives lose all weight.)
    """
    pair = ["metric", "team", "opponent"]
    newest = cuts.agg(F.max("cut")).first()[0]
    if newest is None:
        return cells.sparkSession.createDataFrame([], "metric string, cut long, team long, opponent long, w double, wy double, n long, numerator double, denominator double")
    fresh = lambda at: F.pow(F.lit(0.5), (F.lit(newest) - at) / F.lit(half_life))
    sums = ["w", "wy", "n", "numerator", "denominator"]
    facts = cells.select(*pair, "period", F.lit(1).alias("fact"), (F.col("denominator") * fresh(F.col("period"))).alias("w"), (F.col("numerator") * fresh(F.col("period"))).alias("wy"), "n", "numerator", "denominator")
    first = cells.groupBy(*pair).agg(F.min("period").alias("first"))
    marks = first.join(cuts.select("metric", F.col("cut").alias("period")), "metric").filter("first < period")
    zero = [F.lit(0.0).alias("w"), F.lit(0.0).alias("wy"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("numerator"), F.lit(0.0).alias("denominator")]
    history = Window.partitionBy(*pair).orderBy("period", "fact").rowsBetween(Window.unboundedPreceding, 0)  # a cut stands before the facts of its period
    both = facts.unionByName(marks.select(*pair, "period", F.lit(0).alias("fact"), *zero)).withColumns({c: F.sum(c).over(history) for c in sums})
    age = fresh(F.col("period"))
    return both.filter("fact = 0").select("metric", F.col("period").alias("cut"), "team", "opponent", (F.col("w") / age).alias("w"), (F.col("wy") / age).alias("wy"), "n", "numerator", "denominator")


def ridge_fits(sums: DataFrame, penalties: Sequence[float]) -> DataFrame:
    """(metric, cut, penalty, mean, rated): a fit for each cut and penalty that has rows and teams enough; ``rated`` maps teams
    to their effects. A task reads a row for each pair of teams of a cut."""

    def fit(cells: pd.DataFrame) -> pd.DataFrame:
        found = ridge_effects(cells, penalties) or []
        return pd.DataFrame([(cells["metric"].iloc[0], int(cells["cut"].iloc[0]), p, mean, rated) for p, (mean, rated, _) in zip(penalties, found)], columns=["metric", "cut", "penalty", "mean", "rated"])

    # dealt out by number: few rows, much work
    dealt = sums.repartition(int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions")), "metric", "cut")
    return dealt.groupBy("metric", "cut").applyInPandas(fit, "metric string, cut long, penalty double, mean double, rated map<long,double>")


def played(cells: DataFrame) -> DataFrame:
    """(metric, cut, team, w, y, yy): what errors need of the rows of each period, by team."""
    y = F.col("numerator")
    return cells.groupBy("metric", F.col("period").alias("cut"), "team").agg(F.sum("denominator").alias("w"), F.sum(y).alias("y"), F.sum(y * y / F.col("denominator")).alias("yy"))


def squared_error(predicted: Column) -> Column:
    return F.col("yy") - 2 * predicted * F.col("y") + predicted * predicted * F.col("w")


def leagues(sums: DataFrame) -> DataFrame:
    """(metric, cut, seen, league): rows before each cut, and the rate over all of them."""
    return sums.groupBy("metric", "cut").agg(F.sum("n").alias("seen"), (F.sum("numerator") / F.sum("denominator")).alias("league"))


def ridge_errors(cells: DataFrame, sums: DataFrame, fits: DataFrame, least_train: int) -> DataFrame:
    """(metric, cut, penalty, error, base, weight): squared errors of each fit over its cut's own period, and of the league's rate."""
    rows = played(cells).join(leagues(sums).filter(F.col("seen") >= least_train), ["metric", "cut"]).join(fits, ["metric", "cut"])
    predicted = F.col("mean") + F.coalesce(F.try_element_at("rated", F.col("team")), F.lit(0.0))
    return rows.groupBy("metric", "cut", "penalty").agg(F.sum(squared_error(predicted)).alias("error"), F.sum(squared_error(F.col("league"))).alias("base"), F.sum("w").alias("weight"))


def tune_ridge(games: DataFrame, penalties: Sequence[float], half_life: float = 17.0, least_train: int = 100) -> DataFrame:
    """(metric, penalty, mse, baseline_mse): walk-forward error over the second half of the periods, for each penalty.

    Every period of that half is predicted by a fit of its own over all periods strictly before; fits read sums that age from
    cut to cut. Predictions use the rated side alone; the baseline is the rate over those periods. Periods with fewer than
    ``least_train`` rows before them, and rows without a numerator or volume, are left out.
    """
    cells = save(usable(games), "tuned-facts")
    cuts = save(period_places(cells).filter("k >= periods div 2").select("metric", "cut"), "cuts")
    sums = save(aged_sums(cells, cuts, half_life), "aged-sums")
    errors = ridge_errors(cells, sums, ridge_fits(sums, penalties), least_train)
    totals = errors.groupBy("metric", "penalty").agg(*[F.sum(c).alias(c) for c in ("error", "base", "weight")])
    return totals.select("metric", "penalty", (F.col("error") / F.col("weight")).alias("mse"), (F.col("base") / F.col("weight")).alias("baseline_mse"))


def least_squares(df: DataFrame, features: Sequence[str], target: str) -> tuple[dict[str, float], float, float] | None:
    """Coefficients (with ``intercept``), R² and RMSE from one aggregate of cross products; None without enough rows."""
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    y = F.col(target).cast("double")
    rows = df.dropna(subset=[*features, target])
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(y * y).alias("yy"), F.sum(y).alias("y"), *[F.sum(a * b).alias(f"g{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if i <= j], *[F.sum(a * y).alias(f"r{i}") for i, a in enumerate(x)]).first()
    k = len(x)
    if sums["n"] <= k:
        return None
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    right = np.array([sums[f"r{i}"] for i in range(k)], float)
    beta = np.linalg.lstsq(gram, right, rcond=None)[0]
    rss = max(0.0, sums["yy"] - 2 * beta @ right + beta @ gram @ beta)
    tss = sums["yy"] - sums["y"] ** 2 / sums["n"]
    return dict(zip(["intercept", *features], beta.tolist())), float(1 - rss / tss) if tss > 0 else 0.0, float(np.sqrt(rss / sums["n"]))


def logistic(df: DataFrame, features: Sequence[str], target: str, rounds: int = 50, tolerance: float = 1e-8) -> dict[str, float] | None:
    """Logistic regression by Newton's method; each round is one aggregate over the rows, none of which reach the driver."""
    names = ["intercept", *features]
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    y = F.col(target).cast("double")
    beta = np.zeros(len(x))
    for _ in range(rounds):
        z = sum((F.lit(float(b)) * c for b, c in zip(beta, x)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), z))))
        v = p * (1 - p)
        sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c * (y - p)).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(a * b * v).alias(f"h{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if i <= j]).first()
        if not sums["n"]:
            return None
        hessian = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(len(x))] for i in range(len(x))], float)
        step = np.linalg.lstsq(hessian + 1e-9 * np.eye(len(x)), np.array([sums[f"s{i}"] for i in range(len(x))], float), rcond=None)[0]
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    return dict(zip(names, beta.tolist()))


def shared_pace(seed: int, shape: float, draws: int) -> np.ndarray:
    """The pace of each draw that all entities of a group share; its mean is 1."""
    return np.random.default_rng(seed).gamma(shape, 1 / shape, draws)


def counts_of(seed: int, entity: int, rate: float, pace: np.ndarray) -> np.ndarray:
    """An entity's count in each draw. Its stream comes from the group's seed and the entity, whatever rows are beside it."""
    return np.random.default_rng([seed, entity & (1 << 64) - 1]).poisson(pace * rate)


def simulate(groups: DataFrame, draws: int, seed_column: str = "seed") -> DataFrame:
    """(grp, draw, entity, value): correlated Poisson counts. Entities of a group share a gamma-distributed pace, so their
    values rise and fall together. Input: (grp, entity, rate, shape, seed); the seed comes from the group's key, so any
    task, run again, gives the same draws. A group's entities need not meet in one task."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for grp, entity, rate, shape, seed in rows.itertuples(index=False):
                values = counts_of(int(seed), int(entity), rate, shared_pace(int(seed), shape, draws))
                yield pd.DataFrame({"grp": grp, "draw": np.arange(draws), "entity": entity, "value": values})

    return groups.select("grp", "entity", "rate", "shape", seed_column).mapInPandas(draw, "grp long, draw long, entity long, value long")


def joint_over(groups: DataFrame, draws: int) -> DataFrame:
    """(grp, entity, p, n, joint, independent, lift): each entity's chance to beat its rate, and its group's chance that all
    of its n entities do, beside the product of their chances; ``lift`` is null where that product is 0.

    Input and draws as of ``simulate``, for every entity. Draws do not leave the task: it counts each entity's hits and
    keeps, for each group, the draws in which all its entities hit, as words of 64 bits that are combined afterwards.
    """
    words = -(-draws // 64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paces: dict[tuple, np.ndarray] = {}
            every: dict[int | None, np.ndarray] = {}
            out = []
            for grp, entity, rate, shape, seed in zip(*(c.to_pylist() for c in batch.columns)):
                if (seed, shape) not in paces:
                    paces[seed, shape] = shared_pace(seed, shape, draws)
                hit = counts_of(seed, entity, rate, paces[seed, shape]) > rate
                out.append((grp, entity, int(hit.sum()), None, None))
                every[grp] = every[grp] & hit if grp in every else hit
            for grp, hit in every.items():
                bits = np.packbits(np.append(hit, np.zeros(words * 64 - draws, bool))).view(np.int64)
                out += [(grp, None, None, k, x) for k, x in enumerate(bits.tolist())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["grp", "entity", "hits", "word", "bits"])

    # few rows, much work: the planner leaves out a partitioning by the plain key, which the join has, and puts all in one task
    rows = groups.select("grp", "entity", "rate", "shape", "seed").repartition(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("entity"))
    found = save(rows.mapInArrow(count, "grp long, entity long, hits long, word long, bits long"), "hits")
    each = found.filter("entity IS NOT NULL").select("grp", "entity", (F.col("hits") / draws).alias("p"))
    alone = each.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.when(F.min("p") > 0, F.exp(F.sum(F.ln("p")))).otherwise(0.0).alias("independent"))
    both = found.filter("word IS NOT NULL").groupBy("grp", "word").agg(F.bit_and("bits").alias("bits")).groupBy("grp").agg((F.sum(F.bit_count("bits")) / draws).alias("joint"))
    same = lambda x, y: x["grp"].eqNullSafe(y["grp"])
    of_group = alone.join(both, same(alone, both)).select(alone["grp"].alias("_grp"), "n", "joint", "independent", (F.col("joint") / F.nullif("independent", F.lit(0.0))).alias("lift"))
    return each.join(of_group, each["grp"].eqNullSafe(of_group["_grp"])).drop("_grp")
