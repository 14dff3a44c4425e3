"""Aged sums, walk-forward errors and the choice of a rating's method, against plain loops."""

import numpy as np
import pandas as pd
import pytest

from rateloom.operators import fits, gate


def league_games(seed: int, effect: float, periods: int = 40, teams: int = 10) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    strength = rng.normal(0, effect, teams)
    rows = []
    for period in range(periods):
        order = rng.permutation(teams)
        for a, b in zip(order[::2], order[1::2]):
            for x, y in ((a, b), (b, a)):
                volume = float(rng.integers(5, 40))
                rows.append((int(x), int(y), 1000 + period, volume * (2 + strength[x] + rng.normal(0, 0.3)), volume))
    return pd.DataFrame(rows, columns=["team", "opponent", "period", "numerator", "denominator"])


def plain_sums(games: pd.DataFrame, cut: int, half_life: float) -> dict:
    past = games[(games["period"] < cut) & (games["denominator"] > 0) & games["numerator"].notna()]
    age = 0.5 ** ((cut - past["period"]) / half_life)
    past = past.assign(w=past["denominator"] * age, wy=past["numerator"] * age, n=1)
    return {k: tuple(v) for k, v in past.groupby(["team", "opponent"])[["w", "wy", "n"]].sum().iterrows()}


def test_sums_age_from_cut_to_cut(spark):
    games = league_games(1, 0.4, 12)
    games.loc[3, "numerator"] = None
    games.loc[5, "denominator"] = 0.0
    games = pd.concat([games, games.iloc[7:9]])  # repeated rows count twice
    df = spark.createDataFrame(games.assign(metric="m")).replace(float("nan"), None)
    cells = fits.usable(df)
    cuts = spark.createDataFrame([("m", c) for c in (999, 1000, 1004, 1011, 1030)], "metric string, cut long")
    got = {}
    for r in fits.aged_sums(cells, cuts, 3.0).collect():
        got.setdefault(r.cut, {})[r.team, r.opponent] = (r.w, r.wy, r.n)
    for cut in (999, 1000, 1004, 1011, 1030):
        want = plain_sums(games, cut, 3.0)
        assert got.get(cut, {}).keys() == want.keys()
        for k, v in want.items():
            assert got[cut][k] == pytest.approx(v)
    assert fits.aged_sums(cells, cuts.limit(0)).count() == 0 == fits.aged_sums(cells.limit(0), cuts).count()


def plain_gains(games: pd.DataFrame, penalty: float, beta: float, half_life: float = 17.0) -> tuple[float, float]:
    marks = sorted(games["period"].unique())
    total = np.zeros(3)
    for cut in marks[len(marks) // 3 :]:
        past, now = games[games["period"] < cut], games[games["period"] == cut]
        if len(past) < gate.LEAST_ROWS:
            continue
        league = past["numerator"].sum() / past["denominator"].sum()
        cells = pd.DataFrame([(*k, *v) for k, v in plain_sums(games, cut, half_life).items()], columns=["team", "opponent", "w", "wy", "n"])
        found = fits.ridge_effects(cells, [penalty])
        for r in now.itertuples():
            own = past[past["team"] == r.team].groupby("period")[["numerator", "denominator"]].sum().sort_index().tail(8).sum()
            rate = own["numerator"] / own["denominator"] if own["denominator"] > 0 else league
            ridge = league if found is None else found[0][0] + found[0][1].get(r.team, 0.0)
            y = r.numerator / r.denominator
            total += r.denominator * np.array([(y - league) ** 2, (y - ridge) ** 2, (y - league * (1 + beta * (rate / league - 1))) ** 2])
    return 100 * (1 - total[1] / total[0]), 100 * (1 - total[2] / total[0])


def test_gate_scores_and_chooses(spark):
    """Strong teams: ridge. Teams that are all alike: no signal. Few rows: the trailing rate, shrunk. Additive: pinned."""
    strong, flat = league_games(2, 0.6, 60), league_games(3, 0.0, 60)
    short, few = league_games(4, 0.6, 20, 6), league_games(5, 0.6, 60)
    whole = pd.concat([x.assign(metric=m) for m, x in (("strong", strong), ("flat", flat), ("short", short), ("gap", few))])
    made = gate.Gate(spark.createDataFrame(whole), (5.0, 100.0, 2000.0))
    rows = {r.metric: r for r in made.calibration.collect()}
    assert rows["short"].ridge_gain is None and rows["short"].penalty == gate.DEFAULT_PENALTY
    assert rows["strong"].n == 600 and rows["strong"].penalty == gate.DEFAULT_PENALTY  # fewer than 800 rows choose no penalty
    for m, games in (("strong", strong), ("flat", flat)):
        want = plain_gains(games, rows[m].penalty, rows[m].beta)
        assert (rows[m].ridge_gain, rows[m].raw_gain) == pytest.approx(want, abs=1e-6)
    assert rows["strong"].ridge_gain > 20 > 0 >= rows["flat"].ridge_gain
    told = {}
    for r in made.multipliers(["gap"]).collect():
        told.setdefault(r.metric, []).append(r)
    assert {m: {r.method for r in x} for m, x in told.items()} == {"strong": {"two_way_ridge"}, "flat": {"pinned:no_signal"}, "short": {"shrunk_raw"}, "gap": {"pinned"}}
    assert all(r.multiplier == 1.0 and r.prior_games is None for m in ("flat", "gap") for r in told[m])
    assert all(r.prior_games == 6.0 and abs(r.multiplier - 1) < abs(r.raw_multiplier - 1) for r in told["short"])
    last = strong["period"].max() + 1
    cells = pd.DataFrame([(*k, *v) for k, v in plain_sums(strong, last, 17.0).items()], columns=["team", "opponent", "w", "wy", "n"])
    mean, rated, _ = fits.ridge_effects(cells, [gate.DEFAULT_PENALTY])[0]
    assert {r.team: r.multiplier for r in told["strong"]} == pytest.approx({t: (mean + x) / mean for t, x in rated.items()})


def test_penalty_is_chosen_from_enough_rows(spark):
    games = league_games(6, 0.5, 90)
    made = gate.Gate(spark.createDataFrame(games.assign(metric="m")), (1.0, 5000.0))
    row = made.calibration.first()
    errors = {r.penalty: r.mse for r in fits.tune_ridge(spark.createDataFrame(games.assign(metric="m")), [1.0, 25.0, 5000.0], least_train=gate.LEAST_ROWS).collect()}
    assert row.n == 900 and row.penalty == min(errors, key=errors.get) != 5000.0


def test_gate_of_nothing(spark):
    empty = spark.createDataFrame([], "metric string, team long, opponent long, period long, numerator double, denominator double")
    made = gate.Gate(empty, (5.0,))
    assert made.calibration.count() == 0 == made.multipliers([]).count()
