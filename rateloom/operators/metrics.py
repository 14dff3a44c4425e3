"""Facts by registry: a metric is a numerator and a denominator over events, or over groups of events, of a period.

A branch makes one aggregate for all of its metrics. A two-level branch first aggregates events to their group (a flag or a
figure for each), then groups to the period. All branches come out as (unit, team, period, metric, numerator, denominator).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import reshape


@dataclass(frozen=True)
class Branch:
    """``metrics``: (key, numerator, denominator) as SQL aggregates; with ``group`` they read the columns of ``inner``, aggregates of a group's events."""

    unit: str
    team: str
    metrics: tuple[tuple[str, str, str], ...]
    group: str | None = None
    inner: dict[str, str] = field(default_factory=dict)


def facts(events: DataFrame, branch: Branch, period: str) -> DataFrame:
    """One aggregate over the events (two with groups), unpivoted; a metric without a numerator in a period has no row there."""
    key = [branch.team, period]
    rows = events.filter(F.col(branch.team).isNotNull())
    if branch.group:
        rows = rows.groupBy(*key, branch.group).agg(*[F.expr(e).alias(c) for c, e in branch.inner.items()])
    sums = [F.expr(e).cast("double").alias(f"{side}_{k}") for k, n, d in branch.metrics for side, e in (("n", n), ("d", d))]
    wide = rows.groupBy(*key).agg(*sums)
    pairs = {k: (F.col(f"n_{k}"), F.col(f"d_{k}")) for k, _, _ in branch.metrics}
    long = reshape.unpivot_pairs(wide, key, pairs)
    return long.select(F.lit(branch.unit).alias("unit"), F.col(branch.team).alias("team"), F.col(period).alias("period"), "metric", "numerator", "denominator")


def all_facts(events: DataFrame, branches: Sequence[Branch], period: str = "period") -> DataFrame:
    out = None
    for branch in branches:
        rows = facts(events, branch, period)
        out = rows if out is None else out.unionByName(rows)
    return out


def facts_sql(events: str, branches: Sequence[Branch], period: str = "period") -> str:
    """The same rows as SQL: a branch for each metric."""
    parts = []
    for b in branches:
        rows = f"(SELECT * FROM {events} WHERE {b.team} IS NOT NULL)"
        if b.group:
            rows = f"(SELECT {b.team}, {period}, {b.group}, {', '.join(f'{e} AS {c}' for c, e in b.inner.items())} FROM {rows} GROUP BY 1, 2, 3)"
        parts += [f"SELECT '{b.unit}' AS unit, {b.team} AS team, {period} AS period, '{k}' AS metric, ({n})::DOUBLE AS numerator, ({d})::DOUBLE AS denominator FROM {rows} GROUP BY 2, 3" for k, n, d in b.metrics]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE numerator IS NOT NULL"
