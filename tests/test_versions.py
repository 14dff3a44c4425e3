"""Versioned coefficients and facts by registry, against plain fits and plain loops."""

import numpy as np
import pytest

from rateloom.operators import metrics, versions


def test_versions_are_plain_fits_of_what_came_before(spark):
    rng = np.random.default_rng(2)
    rows = [(t, int(p), float(a), float(b), float(2 + 3 * a - b + rng.normal(0, 0.1) + (p > 20) * a)) for t in ("x", "y") for p in range(10, 34) for a, b in rng.normal(size=(rng.integers(1, 9), 2))]
    rows += [("flat", p, 1.0, float(p), 5.0) for p in range(10, 34)]  # a constant predictor identifies nothing
    df = spark.createDataFrame(rows, "target string, period int, x1 double, x2 double, y double")
    got = {(r.target, r.cutoff): r for r in versions.versions(df, ["target"], "period", 4, 12).collect()}
    for target in ("x", "y"):
        for k, cutoff in enumerate(range(10, 34)):
            past = [r for r in rows if r[0] == target and r[1] < cutoff]
            if k % 4 or len(past) < 12:
                assert (target, cutoff) not in got
                continue
            design = np.array([[1, r[2], r[3]] for r in past])
            beta = np.linalg.lstsq(design, np.array([r[4] for r in past]), rcond=None)[0]
            r = got[target, cutoff]
            assert (r.intercept, r.b1, r.b2, r.n, r["mean"]) == pytest.approx((*beta, len(past), np.mean([q[4] for q in past])), rel=1e-7)
    assert not [k for k in got if k[0] == "flat"]
    assert versions.versions(df.limit(0), ["target"], "period", 4, 12).count() == 0


def test_as_of_reads_the_last_version(spark):
    rows = spark.createDataFrame([("a", p) for p in (1, 2, 5, 5, 9)] + [("b", 4), (None, 3)], "k string, at int")
    table = spark.createDataFrame([("a", 2, 1.0), ("a", 5, None), ("a", 7, 3.0), ("b", 5, 4.0), ("c", 1, 5.0)], "k string, cutoff int, v double")
    got = sorted(((r.k, r["at"], r.cutoff, r.v) for r in versions.as_of(rows, table, ["k"], "at", "cutoff").collect()), key=str)
    assert got == [("a", 2, 2, 1.0), ("a", 5, 5, None), ("a", 5, 5, None), ("a", 9, 7, 3.0)]  # a version that holds a null is still the last one


def test_branches_of_one_and_two_levels(spark):
    events = spark.createDataFrame([(1, 10, "g1", 2.0, "R"), (1, 10, "g1", 3.0, "A"), (1, 10, "g2", 5.0, "R"), (1, 11, "g3", 1.0, "A"), (2, 10, "g4", 4.0, None), (None, 10, "g5", 9.0, "R")], "team int, period int, grp string, x double, flag string")
    plain = metrics.Branch("one", "team", (("total", "sum(x)", "max(1)"), ("returned", "sum(CASE WHEN flag = 'R' THEN x END)", "sum(x)")))
    grouped = metrics.Branch("two", "team", (("groups_returned", "sum(any_r)", "count(*)"), ("largest", "max(total)", "max(1)")), "grp", {"any_r": "max(CASE WHEN flag = 'R' THEN 1 ELSE 0 END)", "total": "sum(x)"})
    got = {(r.unit, r.team, r.period, r.metric): (r.numerator, r.denominator) for r in metrics.all_facts(events, [plain, grouped]).collect()}
    assert got == {
        ("one", 1, 10, "total"): (10.0, 1.0), ("one", 1, 11, "total"): (1.0, 1.0), ("one", 2, 10, "total"): (4.0, 1.0), ("one", 1, 10, "returned"): (7.0, 10.0),  # no row where nothing qualified
        ("two", 1, 10, "groups_returned"): (2.0, 2.0), ("two", 1, 11, "groups_returned"): (0.0, 1.0), ("two", 2, 10, "groups_returned"): (0.0, 1.0),
        ("two", 1, 10, "largest"): (5.0, 1.0), ("two", 1, 11, "largest"): (1.0, 1.0), ("two", 2, 10, "largest"): (4.0, 1.0),
    }


def test_registry_has_every_metric_once():
    from rateloom.plans import registered

    keys = [k for b in registered.BRANCHES for k, _, _ in b.metrics]
    assert len(keys) == len(set(keys)) == 32 and sum(bool(b.group) for b in registered.BRANCHES) == 1
