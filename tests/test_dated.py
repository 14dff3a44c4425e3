"""What was known when, nested reads, and streams that order by event time and refresh one period."""

import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rateloom import streaming
from rateloom.plans import boards, dated, specified


def test_calendar_has_no_chart_from_the_future(spark, sf_dir):
    rows = dated.snapshot_calendar(spark, sf_dir).collect()
    charts = {}
    for r in rows:
        assert r.charted <= r.day
        charts.setdefault(r.event_type, set()).add(r.charted)
    for r in rows:  # the last one, whatever lies between
        assert r.charted == max(c for c in charts[r.event_type] if c <= r.day)
    assert len({r.day for r in rows}) > len({r.charted for r in rows})


def test_days_without_reports_read_the_live_table(spark, sf_dir):
    rows = dated.dated_status(spark, sf_dir).collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r.day, set()).add(r.source)
    assert {frozenset(k) for k in kinds.values()} >= {frozenset({"report"})} and all(k == {"report"} or "report" not in k for k in kinds.values())
    assert len({(r.day, r.user_id) for r in rows}) == len(rows)


def test_nested_board(spark, sf_dir):
    rows = boards.board_nested(spark, sf_dir).collect()
    assert {r.segment for r in rows} == {p.name for p in specified.POSITIONS}
    stats = {p.name: {s.name for s in p.stats} for p in specified.POSITIONS}
    for r in rows:
        assert [e["rank"] for e in r.rows] == list(range(1, len(r.rows) + 1)) and len(r.rows) <= boards.SHOWN
        assert [e["score"] for e in r.rows] == sorted((e["score"] for e in r.rows), reverse=True)
        for e in r.rows:
            assert set(e["headline"]) == stats[r.segment] and e["headline"]["value"]["mean"] == e["score"]
    text = boards.board_nested(spark, sf_dir).select(F.to_json("rows").alias("j")).first().j
    assert json.loads(text)[0]["headline"]["value"]["family"] == "amount"


def test_profiles_hold_every_entity_once(spark, sf_dir):
    rows = boards.entity_profiles(spark, sf_dir).collect()
    want = duckdb.sql(f"SELECT count(*), (SELECT count(DISTINCT o_custkey) FROM '{sf_dir}/orders.parquet') FROM '{sf_dir}/customer.parquet'").fetchall()[0]
    assert len(rows) == len({r.entity for r in rows}) == want[0] and sum(r.log is not None for r in rows) == want[1]
    for r in rows:
        if r.log:
            assert [m.place for m in r.log] == list(range(1, len(r.log) + 1)) and [m.period for m in r.log] == sorted((m.period for m in r.log), reverse=True)
            assert sum(s.n for s in r.seasons.values()) >= sum(m.n for m in r.log)
            assert all(p.trace[-1].value == pytest.approx(p["mean"], abs=2e-5) for p in r.projections.values())


def landed(folder, name: str, rows: list[tuple]) -> None:
    """One file of (user, at in seconds, field, event) in a landing folder."""
    frame = pd.DataFrame(rows, columns=["user", "at", "field", "event"])
    frame["at"] = pd.to_datetime(frame["at"], unit="s")
    frame["at"] = frame["at"].astype("datetime64[us]")
    frame.to_parquet(folder / f"{name}.parquet", index=False)


SCHEMA = "user long, at timestamp_ntz, field string, event long"


def test_changes_follow_event_time_not_batches(spark, tmp_path):
    """Rows of one entity arrive in the wrong order, in several batches; changes come out once, in the order of their times."""
    source, out, check = (tmp_path / x for x in ("in", "out", "check"))
    source.mkdir()
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))

    def run():
        changes = streaming.ordered_changes(stream(), "user", "at", "field", "event", late="100 seconds")
        query = changes.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
        query.awaitTermination()

    landed(source, "a", [(1, 30, "c", 3), (1, 10, "a", 1), (2, 15, None, 9)])
    run()
    landed(source, "b", [(1, 20, "b", 2), (1, 40, "c", 4), (2, 16, "x", 10), (2, 16, None, 11)])
    run()
    landed(source, "c", [(3, 5000, "z", 20), (1, 50, "a", 5)])
    landed(source, "d", [(3, 9000, "z", 21)])
    landed(source, "e", [(3, 9999, "y", 22), (1, 25, "never", 23)])  # later than the watermark: dropped
    run()
    got = sorted(((r.user, r.at.second, r.old_value, r.new_value) for r in spark.read.parquet(str(out)).collect() if r.user in (1, 2)), key=str)
    assert got == sorted([(1, 20, "a", "b"), (1, 30, "b", "c"), (1, 50, "c", "a"), (2, 16, None, "x"), (2, 16, "x", None)], key=str)


def test_refresh_rewrites_the_periods_it_touches(spark, tmp_path):
    """Each batch rebuilds its periods from all that has landed; other periods keep their files, and a repeated run changes nothing."""
    source, out, check = (tmp_path / x for x in ("in", "out", "check"))
    source.mkdir()
    landed(source, "a", [(1, 10, "x", 1), (1, 100_000, "y", 2)])

    def build(rows):
        return rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user").alias("users"))

    def run():
        with_day = lambda df: df.withColumn("day", F.to_date("at").cast("string"))
        stream = with_day(spark.readStream.schema(SCHEMA).parquet(str(source)))
        base = lambda: with_day(spark.read.schema(SCHEMA).parquet(str(source)))
        streaming.refresh_periods(stream, base, build, "day", str(out), str(check)).awaitTermination()

    def told():
        return {str(r.day): (r.n, r.users) for r in spark.read.parquet(str(out)).collect()}

    run()
    assert told() == {"1970-01-01": (1, 1), "1970-01-02": (1, 1)}
    first = sorted(p.name for p in (out / "day=1970-01-01").glob("*.parquet"))
    landed(source, "b", [(2, 100_500, "z", 3), (2, 300_000, "z", 4)])
    run()
    assert told() == {"1970-01-01": (1, 1), "1970-01-02": (2, 2), "1970-01-04": (1, 1)}
    assert sorted(p.name for p in (out / "day=1970-01-01").glob("*.parquet")) == first
    run()
    check.rename(tmp_path / "lost")  # a lost checkpoint reads everything again, and writes the same
    run()
    assert told() == {"1970-01-01": (1, 1), "1970-01-02": (2, 2), "1970-01-04": (1, 1)}
