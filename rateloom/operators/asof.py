"""As-of reads: strictly earlier rows, last-N rows, trailing frames, latest snapshots, nearest times.

All of them are windows over one sort of the entity's history. An entity's history is bounded by time, so a window
partition stays small however many entities there are; nothing here joins a table to itself by an inequality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before(season: str, week: str, target_season: int, target_week: int) -> Column:
    """Rows strictly before a (season, week)."""
    return (F.col(season) < target_season) | ((F.col(season) == target_season) & (F.col(week) < target_week))


def last_n(df: DataFrame, entity: Sequence[str], order: Sequence[Column], n: int, index: str = "games_ago") -> DataFrame:
    """The first ``n`` rows of each entity by ``order`` (most recent first, total), with their place from 0."""
    place = F.row_number().over(Window.partitionBy(*entity).orderBy(*order)) - 1
    return df.withColumn(index, place).filter(F.col(index) < n)


def first_by(df: DataFrame, entity: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep-first deduplication under a total order."""
    return last_n(df, entity, order, 1, "_place").drop("_place")


def only_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keep-none deduplication: rows whose key no other row has. Counts and rows are combined before the exchange."""
    rows = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*df.columns)).alias("_row"))
    return rows.filter("_n = 1").select("_row.*")


def trailing(entity: Sequence[str], order: Sequence[str | Column], rows: int):
    """The frame of the ``rows`` rows strictly before the current one."""
    return Window.partitionBy(*entity).orderBy(*order).rowsBetween(-rows, -1)


def trailing_sum(column: str, frame, least: int) -> Column:
    """Rolling sum; null unless at least ``least`` values in the frame are there."""
    return F.when(F.count(column).over(frame) >= least, F.sum(column).over(frame))


def trailing_mean(column: str, frame, least: int) -> Column:
    return F.when(F.count(column).over(frame) >= least, F.avg(column).over(frame))


def last_facts_before(spine: DataFrame, facts: DataFrame, entity: str, at: str, value: str, n: int, tiebreak: str) -> DataFrame:
    """For each spine row the mean and count of the entity's last ``n`` facts strictly before it.

    Each fact carries the values of itself and of the ``n - 1`` before it. Spine and facts are stacked and sorted, and the last
    such list before a spine row is carried forward, so the cost is two sorts and not the square of an entity's history. The
    values themselves are added, latest first: a difference of running sums would be a bit off where a limit is met exactly.
    Facts at the same time as the spine row do not count.
    """
    own = Window.partitionBy(entity).orderBy(at, "_tie").rowsBetween(1 - n, 0)
    known = facts.select(entity, at, F.col(tiebreak).alias("_tie"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_value"))
    known = known.select(entity, at, "_tie", F.collect_list("_value").over(own).alias("_values"), F.lit(1).alias("_fact"))
    both = spine.select(entity, at, F.col(tiebreak).alias("_tie"), F.lit(None).cast("array<double>").alias("_values"), F.lit(0).alias("_fact")).unionByName(known)
    # spine rows come before the facts of their own time
    earlier = Window.partitionBy(entity).orderBy(at, "_fact", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = both.withColumn("_values", F.last("_values", ignorenulls=True).over(earlier)).filter("_fact = 0")
    total = F.aggregate(F.reverse("_values"), F.lit(0.0), lambda a, x: a + x)
    return rows.select(entity, at, F.col("_tie").alias(tiebreak), F.when(F.col("_values").isNull(), 0).otherwise(F.size("_values")).cast("long").alias("n_prior"), (total / F.size("_values")).alias("prior_mean"))


def own_last_before(df: DataFrame, entity: str, order: Sequence[str], value: str, n: int) -> DataFrame:
    """As above where the facts are the rows themselves and their order is total: a plain frame of ``n`` rows."""
    frame = trailing([entity], order, n)
    return df.withColumn("n_prior", F.count(value).over(frame)).withColumn("prior_mean", F.avg(value).over(frame))


def nearest(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, left_id: str, right_id: str, within_s: int, weight: str | None = None) -> DataFrame:
    """For each left row the right row of its key nearest in time, at most ``within_s`` seconds off; ties: larger weight, then smaller id.

    Both sides are also keyed by a time bucket as wide as the limit, and a left row looks into three buckets, so a key's
    history is not paired with itself.
    """
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / within_s)
    probes = left.withColumn("_b", F.explode(F.array(*[bucket(left_at) + d for d in (-1, 0, 1)])))
    apart = F.abs(F.unix_micros(F.col(left_at).cast("timestamp")) - F.unix_micros(F.col(right_at).cast("timestamp")))
    pairs = probes.join(right.withColumn("_b", bucket(right_at)), [key, "_b"]).withColumn("_apart", apart).filter(F.col("_apart") <= within_s * 1_000_000)
    order = ["_apart", *([F.desc_nulls_last(weight)] if weight else []), right_id]
    return first_by(pairs, [left_id], [F.col(o) if isinstance(o, str) else o for o in order]).withColumn("apart_us", F.col("_apart")).drop("_b", "_apart")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row (key, field, old_value, new_value, change_id) for each field that differs, nulls compared as values."""
    both = old.select(key, *[F.col(f).cast("string").alias(f"o_{f}") for f in fields]).join(new.select(key, *[F.col(f).cast("string").alias(f"n_{f}") for f in fields]), key)
    changes = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").alias("old_value"), F.col(f"n_{f}").alias("new_value")) for f in fields])
    rows = both.select(key, F.explode(F.filter(changes, lambda c: ~c.old_value.eqNullSafe(c.new_value))).alias("c")).select(key, "c.*")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, "field", "old_value", "new_value")]
    return rows.withColumn("change_id", F.md5(F.concat_ws("|", *parts)))
