"""Readers, sinks and streams, in temporary folders."""

import json
import time

import pytest
from pyspark.sql import functions as F

from rateloom.sources import nested_json, registry, sinks
from rateloom.streaming import change_events, upsert_stream, windowed_counts


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_catalogue_aligns_and_drops(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "k int, x string").write.parquet(str(tmp_path / "s1.parquet"))
    spark.createDataFrame([(2, 5)], "k int, y int").write.parquet(str(tmp_path / "s2.parquet"))
    c = registry.Catalogue(spark, str(tmp_path), [registry.Source("s", "s*.parquet", ("key",), {"k": "key"}), registry.Source("gone", "g*.parquet")])
    assert c.refresh() == {"s": True, "gone": False}
    assert rows(spark.table("s").select("key", "x", "y")) == [(1, "a", None), (2, None, 5)]
    assert c.counts() == {"s": 2, "gone": -1}


def test_type_drift_becomes_text(spark, tmp_path):
    spark.createDataFrame([(1,)], "k int").write.parquet(str(tmp_path / "d1.parquet"))
    spark.createDataFrame([("x",)], "k string").write.parquet(str(tmp_path / "d2.parquet"))
    assert rows(registry.read_aligned(spark, str(tmp_path / "d*.parquet"))) == [("1",), ("x",)]


def test_missing_required_column(spark, tmp_path):
    spark.createDataFrame([(1,)], "k int").write.parquet(str(tmp_path / "m.parquet"))
    with pytest.raises(ValueError, match="zz"):
        registry.Catalogue(spark, str(tmp_path), [registry.Source("m", "m.parquet", ("zz",))]).load("m")


def test_current_period(spark):
    df = spark.createDataFrame([(2024, 18, 3), (2025, 1, None), (2025, 2, None)], "season int, week int, score int")
    assert tuple(registry.current_period(df).first()) == (2025, 1)
    assert tuple(registry.current_period(df.filter("score IS NOT NULL")).first()) == (2024, 18)


def test_nested_json(spark):
    text = json.dumps({"7": {"name": "a", "age": "31"}, "8": {"name": None, "age": "x"}})
    assert rows(nested_json.flatten_map(spark.createDataFrame([(text,)], "j string"), "j", {"name": "string", "age": "int"})) == [("7", "a", 31), ("8", None, None)]
    maker = lambda k, p: {"key": k, "markets": [{"key": "total", "outcomes": [{"name": "over", "price": 1.9, "point": p}]}]}
    event = json.dumps([{"id": "e", "home": "h", "away": "a", "start": "t", "makers": [maker("m1", 40.0), maker("m2", 42.0), maker("m3", 47.0)]}])
    out = nested_json.consensus(nested_json.explode_quotes(spark.createDataFrame([(event,)], "j string"), "j"))
    assert rows(out) == [("e", "total", "over", 42.0, 3)]


def test_table_semantics(spark, tmp_path):
    t = sinks.Table(spark, str(tmp_path / "t"))
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert t.read() is None and not t.replace(a.limit(0)) and t.replace(a)
    t.upsert(spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string"), ["k"])
    assert rows(t.read()) == [(1, "x"), (2, "z"), (3, "w")]
    t.insert_ignore(spark.createDataFrame([(1, "no"), (4, "q")], "k int, v string"), ["k"])
    t.replace_where(spark.createDataFrame([(9, "n")], "k int, v string"), "v LIKE 'z%'")
    t.append(spark.createDataFrame([(9, "n")], "k int, v string"))
    assert rows(t.read()) == [(1, "x"), (3, "w"), (4, "q"), (9, "n"), (9, "n")]
    assert not t.replace(a.limit(0)) and t.read().count() == 5
    assert t.vacuum() > 0 and t.read().count() == 5


def test_slices_overwrite_only_their_own(spark, tmp_path):
    path = str(tmp_path / "s")
    sinks.overwrite_slices(spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "season int, week int, v string"), path, ["season", "week"])
    sinks.overwrite_slices(spark.createDataFrame([(1, 2, "c")], "season int, week int, v string"), path, ["season", "week"])
    assert rows(spark.read.parquet(path).select("week", "v")) == [(1, "a"), (2, "c")]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:30:00", "b"), (2, "2024-01-01 01:10:00", "a"), (1, "2024-01-01 02:00:00", "b")], "k long, at string, f string").withColumn("at", F.to_timestamp("at")).write.parquet(src)
    stream = lambda: spark.readStream.schema("k long, at timestamp, f string").parquet(src)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return rows(spark.table(name))

    assert [(str(s)[11:16], k, n) for s, k, n in run(windowed_counts(stream(), "at", "k", "1 hour", "1 hour"), "w", "complete")] == [("00:00", 1, 2), ("01:00", 2, 1), ("02:00", 1, 1)]
    assert [(k, o, n) for k, _, o, n in run(change_events(stream(), "k", "at", "f"), "c", "append")] == [(1, "a", "b")]
    t = sinks.Table(spark, str(tmp_path / "latest"))
    q = upsert_stream(stream(), t, ["k"], ["at"], str(tmp_path / "cp"))
    q.awaitTermination(120)
    time.sleep(0.1)
    assert [(k, f) for k, _, f in rows(t.read().select("k", "at", "f"))] == [(1, "b"), (2, "a")]


def test_period_resolver_falls_back(spark):
    schedule = spark.createDataFrame([(2024, 1, 3.0), (2024, 2, None)], "season long, week long, score double")
    persisted = spark.createDataFrame([(2023, 5, 1), (2023, 6, 2)], "season long, week long, at long")
    got = lambda *sources: tuple(registry.resolve_period(spark, *sources, today="2025-01-15").first())
    assert got(schedule, persisted) == (2024, 2, "schedule") and got(schedule.limit(0), persisted) == (2023, 6, "persisted")
    assert got(None, persisted.limit(0)) == (2024, 18, "calendar") and got(None, None)[2] == "calendar"


def test_footer_counts_and_first_season(spark, tmp_path):
    spark.createDataFrame([(2020, 1), (2021, 2), (2022, 3)], "season long, x long").write.parquet(f"file://{tmp_path}/a")
    assert registry.footer_count(spark, f"file://{tmp_path}/a") == 3
    catalogue = registry.Catalogue(spark, f"file://{tmp_path}", [registry.Source("seasons", "a", min_season=2021)])
    assert catalogue.refresh() == {"seasons": True} and catalogue.counts() == {"seasons": 2}
