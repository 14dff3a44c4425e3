"""Projections by specification: what is computed is what the trace tells."""

import pytest

from rateloom.operators import spec
from rateloom.operators.spec import Position, Stat, Step
from rateloom.plans import specified

GUARD = Position("guard", (Step("a", "volume", "base * share"), Step("b", "share", "share / 2", "half the share", "n"), Step("c", "points", "volume * share")), (Stat("points", "count", ("volume", "share", "points")), Stat("volume", "amount", ("volume",))))
CENTRE = Position("centre", (Step("a", "points", "CASE WHEN base > 5 THEN base ELSE 0 END"),), (Stat("points", "count", ("points",)),))


def test_steps_read_the_steps_before_them(spark):
    rows = spark.createDataFrame([(1, "guard", 10.0, 0.4, 7), (2, "centre", 4.0, 0.1, None), (3, "centre", 6.0, 0.1, 1), (4, "wing", 1.0, 1.0, 1), (5, "guard", None, 0.4, None)], "id int, position string, base double, share double, n int")
    made = spec.compile_all(rows, [GUARD, CENTRE], "position", ["id"])
    means = {(r.id, r.stat): r["mean"] for r in made.collect()}
    assert means == {(1, "points"): pytest.approx(4 * 0.2), (1, "volume"): 4.0, (2, "points"): 0.0, (3, "points"): 6.0, (5, "points"): None, (5, "volume"): None}
    told = [(r.step, r.section, r.label, r.value, r.detail) for r in spec.trace(made, ["id"]).filter("id = 1 AND stat = 'points'").orderBy("step").collect()]
    assert told == [(0, "a", "volume", 4.0, ""), (1, "b", "half the share", 0.2, "7"), (2, "c", "points", pytest.approx(0.8), "")]


def test_specifications_are_checked():
    with pytest.raises(ValueError):
        Position("p", (Step("a", "x", "1"), Step("a", "x", "2")), ())
    with pytest.raises(ValueError):
        Position("p", (Step("a", "x", "1"),), (Stat("s", "count", ("y",)),))


def test_last_step_is_the_mean(spark, sf_dir):
    made = specified.projections(spark, sf_dir).collect()
    assert {r.segment for r in made} == {p.name for p in specified.POSITIONS} and all(r.trace[-1].value == r["mean"] for r in made)
    for r in made:  # a trace can be followed by hand
        value = {t.label: t.value for t in r.trace}
        if r.segment == "MACHINERY" and r.stat == "value":
            assert r["mean"] == pytest.approx(value["team expected value a month"] * value["share of the team value"] * value["counterparty multiplier"])
        if r.segment == "MACHINERY" and r.stat == "points":
            assert r["mean"] == pytest.approx(value["projected orders"] + 3 * value["projected urgent orders"])
