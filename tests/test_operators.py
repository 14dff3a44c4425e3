"""Invariants of single operators on small tables made here."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rateloom.functions import dist, scalar
from rateloom.operators import aggregates, asof, fits, rank, reshape
from rateloom.plans import models


def ridge(games, penalty, half_life):
    """The fit of a pandas frame, its sums made by pandas."""
    rows = games[(games["denominator"] > 0) & games["numerator"].notna()]
    w = 0.5 ** (rows["games_ago"] / half_life)
    rows = rows.assign(w=rows["denominator"] * w, wy=rows["numerator"] * w, n=1)
    found = fits.ridge_effects(rows.groupby(["team", "opponent"], as_index=False)[["w", "wy", "n"]].sum(), [penalty])
    return found[0] if found else None


def round_robin(teams=12, noise=0.0, seed=1):
    rng = np.random.default_rng(seed)
    rated, faced = rng.normal(0, 8, teams), rng.normal(0, 8, teams)
    rows = [(t, o, 100 + rated[t] + faced[o] + rng.normal(0, noise) if noise else 100 + rated[t] + faced[o], 1.0, 0.0) for t in range(teams) for o in range(teams) if t != o]
    return pd.DataFrame(rows, columns=["team", "opponent", "numerator", "denominator", "games_ago"]), rated - rated.mean(), faced - faced.mean()


def test_ridge_recovers_both_sides():
    games, rated, faced = round_robin()
    _, r, f = ridge(games, 1e-6, 17.0)
    assert np.allclose([r[t] for t in range(12)], rated, atol=1e-3)
    assert np.allclose([f[t] for t in range(12)], faced, atol=1e-3)


def test_ridge_shrinks_and_sums_to_zero():
    games, _, _ = round_robin(noise=3.0)
    size = [np.abs(list(ridge(games, p, 17.0)[1].values())).sum() for p in (0.01, 10, 1000)]
    assert size[0] > size[1] > size[2]
    _, r, f = ridge(games, 25, 17.0)
    assert abs(sum(r.values())) < 1e-8 and abs(sum(f.values())) < 1e-8


def test_ridge_separates_schedule_strength():
    rows = [(t, o, 100 + (o - 4.5) * 8, 1.0, 0.0) for t in range(10) for o in range(10) if t != o and (t or o in (1, 2, 3))]
    games = pd.DataFrame(rows, columns=["team", "opponent", "numerator", "denominator", "games_ago"])
    _, rated, _ = ridge(games, 0.01, 17.0)
    assert abs(rated[0]) < 1.0  # its easy schedule is not its own merit


def test_ridge_tuning_fits_before_every_period(spark):
    rng = np.random.default_rng(4)
    games = pd.concat([round_robin(10, 4.0, 7 + p // 4)[0].assign(period=p, metric="m") for p in range(17)]).drop(columns="games_ago")
    games["denominator"] = rng.integers(1, 5, len(games)).astype(float)
    games["numerator"] *= games["denominator"]
    got = {r.penalty: r for r in fits.tune_ridge(spark.createDataFrame(games), [1.0, 50.0]).collect()}
    for penalty in (1.0, 50.0):
        error = base = weight = 0.0
        for cut in range(8, 17):
            train, test = games[games.period < cut], games[games.period == cut]
            mean, rated, _ = ridge(train.assign(games_ago=cut - train.period), penalty, 17.0)
            y, w = test.numerator / test.denominator, test.denominator
            error += (w * (y - mean - test.team.map(rated)) ** 2).sum()
            base += (w * (y - train.numerator.sum() / train.denominator.sum()) ** 2).sum()
            weight += w.sum()
        assert got[penalty].mse == pytest.approx(error / weight) and got[penalty].baseline_mse == pytest.approx(base / weight)


def test_ridge_needs_rows():
    games, _, _ = round_robin()
    assert ridge(games.head(10), 1, 17.0) is None
    assert ridge(games.head(0), 1, 17.0) is None


def test_recent_games_weigh_more():
    games, _, _ = round_robin()
    old, new = games.copy(), games.copy()
    old.loc[old.team == 0, "numerator"] -= 10
    old["games_ago"] = 30.0
    new.loc[new.team == 0, "numerator"] += 10
    r = ridge(pd.concat([old, new]), 0.1, 8.0)[1]
    base = ridge(games, 0.1, 8.0)[1]
    assert r[0] > base[0] + 5


def test_weights_and_effective_size(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(6)], "i int, x double").withColumn("w", aggregates.recency_weight(F.col("i"), F.lit(False)))
    out = df.agg(*[c.alias(k) for k, c in aggregates.weighted_moments(F.col("x"), F.col("w")).items()]).first()
    w = 0.8 ** np.arange(6)
    assert out.ess == pytest.approx(w.sum() ** 2 / (w**2).sum())
    assert out.w_mean == pytest.approx(np.average(np.arange(6), weights=w))
    m = out.w_mean
    assert out.w_variance == pytest.approx((w * (np.arange(6) - m) ** 2).sum() / (w.sum() - (w**2).sum() / w.sum()))
    one = df.limit(1).agg(*[c.alias(k) for k, c in aggregates.weighted_moments(F.col("x"), F.col("w")).items()]).first()
    assert one.w_variance is None


def test_prior_season_discount(spark):
    row = spark.range(1).select(aggregates.recency_weight(F.lit(2), F.lit(True)).alias("w")).first()
    assert row.w == pytest.approx(0.64 * 0.85)


def test_shrink_multiplier(spark):
    df = spark.createDataFrame([(0.0, 2.0, 1.0), (10.0, 2.0, 1.0), (5.0, 2.0, 0.0), (1e9, 2.0, 1.0)], "n double, raw double, lg double")
    got = [r[0] for r in df.select(rank.shrink_multiplier(F.col("n"), F.col("raw"), F.col("lg"), 10)).collect()]
    assert got[0] == 1.0 and got[1] == pytest.approx(1.5) and got[2] == 1.0 and got[3] == pytest.approx(2.0, abs=1e-6)


def test_average_percentile_ties(spark):
    df = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 2.0, 3.0)], "g int, v double").withColumn("p", rank.average_percentile("v", ["g"]))
    assert sorted(r.p for r in df.collect()) == [0.25, 0.625, 0.625, 1.0]


def test_z_score_of_constant_is_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 1.0)], "g int, v double").withColumn("z", rank.z_score("v", ["g"]))
    assert {r.z for r in df.collect()} == {0.0}


def test_last_facts_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    facts = pd.DataFrame({"u": rng.integers(0, 5, 200), "at": rng.integers(0, 60, 200), "id": np.arange(200), "v": rng.normal(size=200)})
    spine = pd.DataFrame({"u": rng.integers(0, 6, 80), "at": rng.integers(0, 60, 80), "id": np.arange(80)})
    got = asof.last_facts_before(spark.createDataFrame(spine), spark.createDataFrame(facts), "u", "at", "v", 4, "id").toPandas().set_index("id")
    for r in spine.itertuples():
        own = facts[(facts.u == r.u) & (facts["at"] < r.at)].sort_values(["at", "id"]).tail(4)
        assert got.loc[r.id, "n_prior"] == len(own)
        assert own.empty and math.isnan(got.loc[r.id, "prior_mean"]) or got.loc[r.id, "prior_mean"] == pytest.approx(own.v.mean())


def test_before_is_strict(spark):
    df = spark.createDataFrame([(2024, 5), (2024, 6), (2025, 1), (2025, 2), (2025, 3)], "s int, w int")
    assert df.filter(asof.before("s", "w", 2025, 2)).count() == 3


def test_trailing_sum_needs_full_window(spark):
    df = spark.createDataFrame([(1, i, float(i) if i != 2 else None) for i in range(6)], "e int, t int, v double")
    out = df.withColumn("s", asof.trailing_sum("v", asof.trailing(["e"], ["t"], 2), 2)).orderBy("t").collect()
    assert [r.s for r in out] == [None, None, 1.0, None, None, 7.0]


def test_snapshot_diff_compares_nulls(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", None)], "k int, f string, g string")
    new = spark.createDataFrame([(1, "a", "y"), (2, "b", "x"), (3, None, None)], "k int, f string, g string")
    out = {(r.k, r.field, r.old_value, r.new_value) for r in asof.snapshot_diff(old, new, "k", ["f", "g"]).collect()}
    assert out == {(1, "g", None, "y"), (3, "f", "c", None)}


def test_match_cascade_takes_only_unique(spark):
    left = spark.createDataFrame([(1, "a", "n1"), (2, "b", "n2"), (3, "b", "n3"), (4, None, "n4"), (5, None, "n4")], "l int, k string, n string")
    right = spark.createDataFrame([(11, "a", "zz"), (12, "b", "n2"), (13, "q", "n3"), (14, None, "n4")], "r int, k string, n string")
    out = {(x.l, x.r, x.matched_by) for x in reshape.match_cascade(left, right, "l", "r", [("id", F.col("k"), F.col("k")), ("name", F.col("n"), F.col("n"))]).collect()}
    assert out == {(1, 11, "id"), (2, 12, "name"), (3, 13, "name")}


def test_oriented_turns_the_sign(spark):
    right = spark.createDataFrame([("x", "y", 3.0), ("q", "p", 5.0)], "a string, b string, v double")
    left = spark.createDataFrame([("x", "y"), ("y", "x"), ("p", "q"), ("m", "n")], "a string, b string")
    got = {(r.a, r.b): r.v for r in reshape.oriented(left, right, "a", "b", "v").collect()}
    assert got == {("x", "y"): 3.0, ("y", "x"): -3.0, ("p", "q"): -5.0, ("m", "n"): None}


def test_sides_and_tolerant(spark):
    df = spark.createDataFrame([(1, "h", "a", "7x")], "g int, home string, away string, n string")
    assert {(r.team, r.other, r.is_home) for r in reshape.sides(df, ["g"], {"team": "home", "other": "away"}, {"team": "away", "other": "home"}).collect()} == {("h", "a", True), ("a", "h", False)}
    assert df.select(reshape.tolerant(df, "n", "int").alias("n"), reshape.tolerant(df, "nope", "int").alias("m")).first() == (None, None)


def test_mixture_moments_against_draws(spark):
    p, s, m, v = 0.6, 0.9, 85.0, 400.0
    row = spark.range(1).select(dist.mixture_mean(F.lit(p), F.lit(s), F.lit(m)).alias("m"), dist.mixture_variance(F.lit(p), F.lit(s), F.lit(m), F.lit(v)).alias("v")).first()
    rng = np.random.default_rng(0)
    x = rng.binomial(1, p, 400_000) * s * rng.normal(m, math.sqrt(v), 400_000)
    assert row.m == pytest.approx(x.mean(), rel=0.01) and row.v == pytest.approx(x.var(), rel=0.01)


def test_poisson_and_negative_binomial():
    t = dist.pmf_table("poisson", 1.5, 1.0)
    assert t[0] == pytest.approx(0.2231, abs=1e-4) and 1 - t[:2].sum() == pytest.approx(0.4422, abs=1e-4)
    nb = dist.pmf_table("nb", 1.66290920, 0.02120168)
    cdf = np.cumsum(nb)
    assert [int(np.searchsorted(cdf, q)) for q in (0.25, 0.5, 0.75)] == [33, 62, 105]
    assert 1 - cdf[39] == pytest.approx(0.687560, abs=1e-5)


def test_half_units_and_strict_lines(spark):
    df = spark.createDataFrame([("poisson", 2.4, 0.5, 1.0), ("poisson", 2.4, 0.5, 0.9), ("poisson", 2.4, 1.0, -1.0)], "f string, a double, b double, line double")
    a, b, c = (r[0] for r in df.select(dist.p_over("f", "a", "b", "line")).collect())
    t = dist.pmf_table("poisson", 2.4, 1.0)
    assert a == pytest.approx(1 - t[:3].sum()) and b == pytest.approx(1 - t[:2].sum()) and c == 1.0


def test_count_family_threshold_is_exclusive(spark):
    df = spark.createDataFrame([(5.0, 5.5), (5.0, 9.0), (10.0, 13.0)], "m double, v double")
    assert [r[0] for r in df.select(dist.count_family(F.col("m"), F.col("v"))).collect()] == ["poisson", "nb", "poisson"]


def test_scalar_parsers(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(scalar.name_key(F.lit("  D'Andre O'Neil Jr. "), F.lit("KC"))) == "dandre oneil|KC"
    assert get(scalar.height_inches(F.lit("6'2\""))) == 74 and get(scalar.height_inches(F.lit("tall"))) is None
    assert [get(scalar.practice_status(F.lit(x))) for x in ("Full Participation in Practice", "DNP", "", None)] == ["Full", "DNP", "Unknown", "Unknown"]
    assert get(scalar.american_odds(F.lit(0.6))) == -150 and get(scalar.american_odds(F.lit(0.4))) == 150 and get(scalar.american_odds(F.lit(1.0))) is None


def test_logistic_recovers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-(0.5 - 1.2 * x)))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y.astype(float)}))
    beta = fits.logistic(df, ["x"], "y")
    assert beta["intercept"] == pytest.approx(0.5, abs=0.15) and beta["x"] == pytest.approx(-1.2, abs=0.15)


def test_simulation_is_seeded_and_correlated(spark):
    df = spark.createDataFrame([(1, 1, 5.0, 4.0, 9), (1, 2, 5.0, 4.0, 9)], "grp long, entity long, rate double, shape double, seed long")
    a, b = (fits.simulate(df, 2000).toPandas().sort_values(["draw", "entity"], ignore_index=True) for _ in range(2))
    assert a.equals(b)
    wide = a.pivot(index="draw", columns="entity", values="value")
    assert wide.corr().iloc[0, 1] > 0.3 and wide.mean().between(4.5, 5.5).all()


def test_joint_chance_of_whole_groups(spark):
    rows = [(g, 10 * (g or 0) + k, 2.0 + k, 2.0, 7 + (g or 0)) for g, n in ((1, 4), (2, 1), (None, 2)) for k in range(n)] + [(3, 100 + k, 1.5, 6.0, 10) for k in range(300)]
    df = spark.createDataFrame(rows, "grp long, entity long, rate double, shape double, seed long")
    out = {(r.grp, r.entity): r for r in fits.joint_over(df, 1000).collect()}
    assert len(out) == len(rows)
    for g in (1, 2, None, 3):
        own = [r for r in rows if r[0] == g]
        over = np.stack([fits.counts_of(r[4], r[1], r[2], fits.shared_pace(r[4], r[3], 1000)) > r[2] for r in own])
        alone, joint = over.mean(axis=1), over.all(axis=0).mean()
        for r, p in zip(own, alone):
            got = out[g, r[1]]
            assert (got.n, got.joint, got.p) == (len(own), pytest.approx(joint), pytest.approx(p)) and got.independent == pytest.approx(alone.prod())
            assert got.lift == pytest.approx(joint / alone.prod())
    assert out[1, 10].joint > 2 * out[1, 10].independent > 0


def test_joint_query_has_every_entity(spark, sf_dir):
    want = {r.o_custkey for r in models.moments(spark, sf_dir).collect()}
    assert {r.entity for r in models.monte_carlo_joint(spark, sf_dir).collect()} == want and len(want) > 50


@settings(max_examples=25, deadline=None)
@given(st.floats(0.1, 30), st.floats(0.05, 5))
def test_pmf_sums_to_one(mean, alpha):
    r = 1 / alpha
    assert dist.pmf_table("nb", r, r / (r + mean)).sum() == pytest.approx(1, abs=1e-9)
    assert dist.pmf_table("poisson", mean, 1.0).sum() == pytest.approx(1, abs=1e-9)


def test_marginal_keeps_null_cells_apart(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", None, 3.0), ("b", "x", 5.0)], "c string, s string, v double")
    out = {(r.c, r.s): r.n for r in aggregates.with_marginal(df, ["c", "s"], "s", {"n": F.count(F.lit(1))}).collect()}
    assert out == {("a", "x"): 1, ("a", None): 1, ("b", "x"): 1, ("a", "ALL"): 2, ("b", "ALL"): 1}


def test_bounded_event_fit_is_a_minimum(spark):
    """Two kinds of events; one slope is truly zero, one intercept negative. No step within the bounds lowers the loss."""
    from rateloom.operators import events_fit

    rng = np.random.default_rng(3)
    x = rng.random((6000, 4))
    group, w = rng.integers(0, 2, 6000), rng.uniform(0.02, 1, 6000)
    true = np.array([[-0.2, 0.9, 0.0, 0.05, 0.3, 0.5], [0.1, 0.0, 0.4, -0.3, 0.0, 1.2]])[group]
    rate = 1.5 * np.maximum(0, true[:, 0] + (true[:, 1:3] * x[:, :2]).sum(1)) + 0.8 * np.maximum(0, true[:, 3] + (true[:, 4:] * x[:, 2:]).sum(1))
    y = (rng.random(6000) < -np.expm1(-rate)).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"g": group.astype(str), "y": y, "w": w, "a": 1.5, "b": 0.8, **{f"x{i + 1}": x[:, i] for i in range(4)}})).persist()
    found = events_fit.fit_events(df, "g")
    low, high = events_fit.BOUNDS.T
    for g in (0, 1):
        own = group == g

        def loss(t):
            r = 1.5 * np.maximum(0, t[0] + x[own, :2] @ t[1:3]) + 0.8 * np.maximum(0, t[3] + x[own, 2:] @ t[4:])
            p = np.clip(-np.expm1(-r), 1e-4, 1 - 1e-4)
            return -(w[own] * (y[own] * np.log(p) + (1 - y[own]) * np.log1p(-p))).sum() / w[own].sum()

        theta, told = found[str(g)]
        assert told == pytest.approx(loss(theta)) and (theta >= low).all() and (theta <= high).all() and told < loss(events_fit.BEGIN)
        for step in (1e-3, 1e-2, 0.1):
            for d in np.vstack([np.eye(6), -np.eye(6), rng.normal(size=(40, 6))]):
                assert told <= loss(np.clip(theta + step * d, low, high)) + 1e-7
    assert found["0"][0][1] > 0.5 and found["1"][0][5] > 0.7 and min(found["1"][0][1], found["0"][0][2]) < 0.25


def test_last_facts_are_added_themselves(spark):
    """Four values of 0.55 after large ones: their mean is 0.55, and meets a limit of 0.55."""
    facts = spark.createDataFrame([(1, k, k, v) for k, v in enumerate([1e9, 0.1, 3e7, 0.55, 0.55, 0.55, 0.55])], "u long, at long, id long, v double")
    spine = spark.createDataFrame([(1, 7, 100), (1, 0, 101), (2, 7, 102)], "u long, at long, id long")
    got = {r.id: (r.n_prior, r.prior_mean) for r in asof.last_facts_before(spine, facts, "u", "at", "v", 4, "id").collect()}
    assert got == {100: (4, 0.55), 101: (0, None), 102: (0, None)}


def test_event_sums_of_tasks_are_whole(spark, monkeypatch):
    """Sums over many small tasks, for several starts in one pass, are loss, gradient and curvature over all rows."""
    from rateloom.operators import events_fit

    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"g": rng.choice(["u", "v", "w"], 900), "y": rng.integers(0, 2, 900), "w": rng.uniform(0.02, 1, 900), "a": 1.5, "b": 0.8, **{f"x{i}": rng.random(900) for i in range(1, 5)}})
    monkeypatch.setattr(events_fit, "BLOCK_ROWS", 7)
    blocks = events_fit.blocks_of(spark.createDataFrame(pdf).repartition(40), "g").cache()
    assert {r.g: r.n for r in blocks.groupBy("g").agg(F.sum(F.length("block") / 64).alias("n")).collect()} == dict(pdf.g.value_counts()) and blocks.filter("length(block) > 7 * 64").count() == 0
    thetas = {(g, k): t for g in "uv" for k, t in enumerate(events_fit.STARTS)}
    found = events_fit.sums_at(blocks, "g", thetas)
    assert set(found) == set(thetas)
    for (g, k), t in thetas.items():
        own = pdf[pdf.g == g]

        def loss(t):
            rate = own.a * np.maximum(0, t[0] + t[1] * own.x1 + t[2] * own.x2) + own.b * np.maximum(0, t[3] + t[4] * own.x3 + t[5] * own.x4)
            p = np.clip(-np.expm1(-rate), 1e-4, 1 - 1e-4)
            return -(own.w * (own.y * np.log(p) + (1 - own.y) * np.log1p(-p))).sum() / own.w.sum()

        assert found[g, k][0] == pytest.approx(loss(t), rel=1e-9) and found[g, k][2] == pytest.approx(found[g, k][2].T)
        slope = np.array([(loss(t + 1e-6 * d) - loss(t - 1e-6 * d)) / 2e-6 for d in np.eye(6)])
        assert found[g, k][1] == pytest.approx(slope, abs=1e-4)
    whole = events_fit.partial_sums(pdf[pdf.g == "u"][["y", "w", "a", "b", "x1", "x2", "x3", "x4"]].to_numpy(float).T, events_fit.STARTS[1])
    assert whole[1] / whole[0] == pytest.approx(found["u", 1][0])


def test_event_steps_do_not_depend_on_units():
    """A table of ten thousand times as many entities: shares so much smaller, events of a team so many more. The rates move alike."""
    from rateloom.operators import events_fit

    rng = np.random.default_rng(2)
    d = rng.random((50, 6))
    curve, slope, theta = d.T @ d / 50, rng.normal(size=6), np.array([0.1, 1.0, 1.0, 0.1, 1.0, 1.0])
    unit = np.array([1e3, 1e-4, 1.0] * 2)  # of intercepts, shares and ratios
    for step in (events_fit.step_of, events_fit.slope_step):
        assert step(theta, slope * unit, curve * np.outer(unit, unit)) * unit == pytest.approx(step(theta, slope, curve), rel=1e-6)
