"""Laws as column expressions, against plain sums, closed forms and sorted samples."""

import itertools
import math
import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rateloom.functions import dist, laws
from rateloom.plans import calibrated, models
from rateloom.shared import importable


def plain_masses(mean: float, variance: float | None, n: int) -> np.ndarray:
    if variance is None:
        return np.array([math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) for k in range(n)])
    r = 1 / max((variance - mean) / mean**2, 1e-9)
    p = r / (r + mean)
    return np.array([math.exp(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(p) + k * math.log1p(-p)) for k in range(n)])


CASES = [(0.3, None), (2.0, None), (900.0, None), (1.5, 4.0), (85.0, 4000.0), (0.05, 0.3), (3.0, 3.15)]


def test_masses_sums_and_quantiles(spark):
    rows = [(i, m, v, x) for i, (m, v) in enumerate(CASES) for x in (-1, 0, 1, 4, 70, 950)]
    df = spark.createDataFrame(rows, "i int, m double, v double, x int")
    law = laws.spread_law(F.col("m"), F.col("v"))
    out = df.select("*", laws.mass_at(F.col("x"), law).alias("at"), laws.over(F.col("x") + 0.5, law).alias("over"), laws.quantiles([0.25, 0.5, 0.75], law, F.col("m"), F.coalesce("v", "m")).alias("q")).collect()
    for r in out:
        p = plain_masses(r.m, r.v, 3000)
        below = p[: max(r.x, 0)].sum()
        here = p[r.x] if r.x >= 0 else 0.0
        assert (r["at"].below, r["at"].here) == pytest.approx((below, here), rel=1e-8, abs=1e-11)
        assert r.over == pytest.approx(1 - below - here, abs=1e-9)
        assert r.q == [float(np.searchsorted(np.cumsum(p), q - 1e-12)) for q in (0.25, 0.5, 0.75)]


def test_families_of_rows(spark):
    df = spark.createDataFrame([("poisson", 2.4, 0.5), ("nb", 1.66290920, 0.02120168), ("bernoulli", 0.3, 0.0), ("bernoulli", 0.8, 0.0)], "f string, a double, b double")
    half, nb, no, yes = (r[0] for r in df.select(dist.quantiles("f", "a", "b", [0.25, 0.5, 0.75])).collect())
    assert nb == [33.0, 62.0, 105.0] and half == [x / 2 for x in (1.0, 2.0, 3.0)] and no == [0.0, 0.0, 1.0] and yes == [1.0, 1.0, 1.0]
    over = [[r[0] for r in df.select(dist.p_over("f", "a", "b", F.lit(line))).collect()] for line in (0.0, 0.5, 1.0)]
    assert over[0][2:] == pytest.approx([0.3, 0.8]) and over[1][2:] == pytest.approx([0.3, 0.8]) and over[2][2:] == pytest.approx([0.0, 0.0])


@settings(max_examples=30, deadline=None)
@given(st.floats(0.01, 2000), st.floats(0.001, 3000))
def test_incomplete_gamma(spark, shape, x):
    """P(a + 1, x) = P(a, x) - x^a e^-x / Γ(a + 1), also where the series hands over to the fraction."""
    at = lambda a: laws.gamma_cdf(F.lit(x), F.lit(a), F.lit(1.0))
    one, more, log = spark.range(1).select(at(shape), at(shape + 1), laws.log_gamma(F.lit(shape))).first()
    assert log == pytest.approx(math.lgamma(shape), rel=1e-11, abs=1e-11)
    assert 0 <= more <= one <= 1 and more == pytest.approx(one - math.exp(shape * math.log(x) - x - math.lgamma(shape + 1)), abs=1e-9)


def test_continuous_closed_forms(spark):
    one = spark.range(1)
    for x in (0.01, 0.5, 1.0, 4.0, 30.0):
        assert one.select(laws.gamma_cdf(F.lit(x), F.lit(0.5), F.lit(1.0))).first()[0] == pytest.approx(math.erf(math.sqrt(x)), abs=1e-10)
        assert one.select(laws.gamma_cdf(F.lit(x), F.lit(1.0), F.lit(2.0))).first()[0] == pytest.approx(1 - math.exp(-x / 2), abs=1e-10)
    for a, b, x in ((3, 5, 0.2), (1, 1, 0.7), (40, 2, 0.99), (400, 300, 0.6)):
        want = sum(math.exp(math.lgamma(a + b) - math.lgamma(j + 1) - math.lgamma(a + b - j) + j * math.log(x) + (a + b - 1 - j) * math.log1p(-x)) for j in range(a, a + b))
        assert one.select(laws.beta_cdf(F.lit(x), F.lit(float(a)), F.lit(float(b)))).first()[0] == pytest.approx(want, abs=1e-10)
    assert [one.select(laws.beta_cdf(F.lit(x), F.lit(2.0), F.lit(3.0))).first()[0] for x in (-0.1, 0.0, 1.0, 1.5)] == [0.0, 0.0, 1.0, 1.0]
    assert one.select(laws.beta_cdf(F.lit(0.25), F.lit(0.5), F.lit(0.5))).first()[0] == pytest.approx(2 / math.pi * math.asin(0.5), abs=1e-10)
    assert one.select(laws.gamma_cdf(F.lit(-1.0), F.lit(2.0), F.lit(1.0))).first()[0] == 0.0


def test_weighted_sums(spark):
    df = spark.createDataFrame([(a, b, line) for a, b in ((1.6, 2.3), (0.2, 9.0)) for line in (-1.0, 0.0, 2.5, 9.0, 20.0)], "a double, b double, line double")
    for r in df.withColumn("p", laws.weighted_sum_over(F.col("line"), F.lit(3), laws.poisson(F.col("a")), laws.poisson(F.col("b")), 1000)).collect():
        p, q = plain_masses(r.a, None, 60), plain_masses(r.b, None, 60)
        assert r.p == pytest.approx(1 - sum(p[i] * q[j] for i in range(60) for j in range(60) if 3 * i + j <= r.line), abs=1e-12)


def test_empirical_laws(spark):
    rng = np.random.default_rng(4)
    values = {"many": np.where(rng.random(5000) < 0.3, 0, np.round(rng.gamma(2, 10, 5000), 2)), "few": np.array([0.0, 5.0, 1.0, 1.0]), "none": np.zeros(7), "ties": np.full(900, 3.0), None: np.array([2.0, 4.0])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in values.items() for x in xs] + [("few", None)], "g string, x double")
    rows = laws.empirical(df, ["g"], "x", points=100)
    out = {r.g: r for r in rows.withColumn("over", F.array(*[laws.empirical_over(F.lit(x), F.col("zero"), F.col("support")) for x in (-1.0, 0.0, 3.0, 17.5, 1e9)])).withColumn("q", F.array(*[laws.empirical_quantile(q, F.col("zero"), F.col("support")) for q in (0.1, 0.5, 1.0)])).collect()}
    for g, xs in values.items():
        positive = np.sort(xs[xs > 0])
        want = positive if len(positive) <= 100 else positive[(np.arange(100) * (len(positive) - 1)) // 99]
        assert out[g].support == want.tolist() and out[g].n == len(xs) and out[g].zero == pytest.approx((xs == 0).mean())
        share = [(want > x).mean() if len(want) else 0.0 for x in (0.0, 3.0, 17.5, 1e9)]
        assert out[g].over == pytest.approx([1.0] + [(1 - out[g].zero) * s for s in share])
    assert out["none"].q == [0.0, 0.0, 0.0] and out["few"].q == [0.0, 1.0, 5.0] and out["many"].q[0] == 0.0 and abs(out["many"].over[3] - (values["many"] > 17.5).mean()) < 0.02


def test_widths_borrow_and_keep_one(spark, monkeypatch):
    """Counts of a wider law than told get a scale above 1, rightly told ones keep 1, small cells take their statistic's."""
    rng = np.random.default_rng(8)
    rows = []
    for team, n, true in ((1, 900, 20.0), (2, 900, 60.0), (3, 20, 60.0)):
        for k in range(n):
            x = rng.negative_binomial(10, 1 / 3) if true > 20 else rng.poisson(20)
            rows.append((k, team, 2000, "s", float(x), 20.0, 20.0, False))
    df = spark.createDataFrame(rows, "entity long, team long, season long, stat string, x double, m double, v double, wide boolean")
    monkeypatch.setattr(calibrated, "count_laws", lambda *_: df)
    out = {r.team: r for r in calibrated.width_by_pit(spark, "").collect()}
    assert not out[1].borrowed and out[1].scale <= 1.25 and not out[2].borrowed and out[2].scale >= 2.25
    assert abs(out[2].after - 0.5) < abs(out[2].before - 0.5)
    assert out[3].borrowed and out[3].n == 20 and out[1].scale <= out[3].scale <= out[2].scale


def test_event_score_varies(spark, sf_dir):
    rows = calibrated.count_scorecard(spark, sf_dir).collect()
    assert len({r.brier for r in rows}) > 10 and all(0 <= r.p_event <= 1 and r.brier != 0.25 for r in rows)


def test_ratio_of_exactly_the_limit_is_not_over_it(spark):
    """Variances of 1.3 means, as sums in several orders leave them: a unit of the last digit more or less."""
    rows = [(m, v) for m in (8 / 3, 10 / 3, 0.7) for v in (1.3 * m, np.nextafter(1.3 * m, 9), np.nextafter(np.nextafter(1.3 * m, 9), 9), np.nextafter(1.3 * m, 0))]
    df = spark.createDataFrame([(float(m), float(v)) for m, v in rows], "m double, v double")
    assert {r[0] for r in df.select(dist.count_family(F.col("m"), F.col("v"))).collect()} == {"poisson"}


def test_variance_of_counts_does_not_depend_on_their_order(spark, tmp_path):
    """Customers with the same six yearly counts in all orders of the years have one variance, 52 / 15, and one law."""
    orders = sorted(set(itertools.permutations((1, 1, 2, 2, 5, 5))))
    rows = [(c, year) for c, counts in enumerate(orders) for year, k in enumerate(counts) for _ in range(k)]
    table = pd.DataFrame({"o_custkey": [c for c, _ in rows], "o_orderdate": [pd.Timestamp(1995 + y, 3, 1) for _, y in rows]})
    spark.createDataFrame(table).repartition(7).write.parquet(f"{tmp_path}/orders.parquet")
    assert {(r.m, r.v) for r in models.moments(spark, str(tmp_path)).collect()} == {(16 / 6, 52 / 15)}
    assert {(r.r, r.p, r.family) for r in models.nb_params(spark, str(tmp_path)).collect()} == {(8.88889, 0.769231, "poisson")}


def test_weighted_sum_takes_its_line_as_it_stands(spark):
    """A sum of 4 is over a line that is a bit under 4."""
    a, b = 2.2, 0.6
    line = math.nextafter(4.0, 0.0)
    p = [(plain_masses(a, None, 9), plain_masses(b, None, 4))]
    for at, most in ((line, 3), (4.0, 4)):
        want = 1 - sum(x[i] * y[j] for x, y in p for i in range(9) for j in range(4) if i + 3 * j <= most)
        got = spark.range(1).select(laws.weighted_sum_over(F.lit(at), F.lit(3), laws.poisson(F.lit(b)), laws.poisson(F.lit(a)), 100)).first()[0]
        assert got == pytest.approx(want, abs=1e-9)


def test_walks_side_by_side(spark, monkeypatch):
    """The same quantiles as by the expression, whatever the blocks; 4,000 long laws take no minute."""
    rng = np.random.default_rng(8)
    mean = np.round(np.concatenate([rng.gamma(0.4, 60, 300), [0.0, -1.0, 1e-9, 4200.0]]), 9)
    rows = [(i, float(m), float(max(1.05 * m, m + 0.4 * m * m)) if i % 3 else None) for i, m in enumerate(mean)] + [(-1, None, None), (-2, None, 3.0)]
    df = spark.createDataFrame(rows, "i int, m double, v double")
    law = laws.spread_law(F.col("m"), F.col("v"))
    want = {r.i: r.q for r in df.select("i", F.when(F.col("m") > 0, laws.quantiles([0.25, 0.5, 0.75], law, F.col("m"), F.coalesce("v", "m"))).alias("q")).collect()}
    importable(spark)
    assert {r.i: r.q for r in df.select("i", laws.spread_quantiles([0.25, 0.5, 0.75], F.col("m"), F.col("v")).alias("q")).collect()} == want
    monkeypatch.setattr(laws, "BLOCK", 7)
    monkeypatch.setattr(laws, "HELD_TERMS", 70)
    m, v = (np.array([np.nan if r[k] is None else r[k] for r in rows]) for k in (1, 2))
    for r, q in zip(rows, laws.walk_quantiles([0.25, 0.5, 0.75], m, v)):
        assert want[r[0]] == q.tolist() or (want[r[0]] is None and np.isnan(q).all())
    monkeypatch.undo()
    began = time.perf_counter()
    big = rng.uniform(2000, 4000, 4000)
    assert not np.isnan(laws.walk_quantiles([0.25, 0.5, 0.75], big, big + 0.4 * big * big)).any()
    assert time.perf_counter() - began < 60
