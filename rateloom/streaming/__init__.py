"""Structured Streaming forms of the incremental behaviours: latest state, change events, windowed counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.sinks import Table

#: Periods of a batch that are told to all tasks; more are joined.
MOST_PERIODS = 10_000


def windowed_counts(events: DataFrame, at: str, key: str, size: str, late: str) -> DataFrame:
    """Counts in tumbling event-time windows; rows later than the watermark are dropped by its definition."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.groupBy(F.window(at, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def change_events(events: DataFrame, key: str, at: str, field: str) -> DataFrame:
    """(key, at, old_value, new_value) whenever an entity's field changes; the last value is the state. Null is a value."""
    schema = f"{key} long, {at} timestamp, old_value string, new_value string"

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last = (True, state.get[0]) if state.exists else (False, None)
        rows = pd.concat(list(batches)).sort_values([at, "_id"], kind="stable")
        out = []
        for t, value in zip(rows[at], rows[field].where(rows[field].notna(), None)):
            if seen and value != last:
                out.append((name[0], t, last, value))
            seen, last = True, value
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, at, "old_value", "new_value"])

    rows = events.select(F.col(key).cast("long").alias(key), F.col(at).cast("timestamp").alias(at), F.col(field).cast("string").alias(field), F.xxhash64(key, at, field).alias("_id"))
    return rows.groupBy(key).applyInPandasWithState(step, schema, "last string", "append", GroupStateTimeout.NoTimeout)


class OrderedChanges(StatefulProcessor):
    """Holds an entity's rows until the watermark has passed them, then tells the changes between them in the order of their times."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "value string")
        self.waiting = handle.getMapState("waiting", "at long, event long", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            for at, event, value in zip(batch["us"], batch["event"], batch["value"].where(batch["value"].notna(), None)):
                if at // 1000 >= passed:
                    self.waiting.updateValue((int(at), int(event)), (value,))
                    self.handle.registerTimer(int(at) // 1000 + 1)
        yield pd.DataFrame({"key": pd.Series(dtype="int64"), "us": pd.Series(dtype="int64"), "old_value": pd.Series(dtype=str), "new_value": pd.Series(dtype=str)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit, out = expiredTimerInfo.getExpiryTimeInMs(), []
        due = sorted(k for k in self.waiting.keys() if k[0] // 1000 < limit)
        for place in due:
            value = self.waiting.getValue(place)[0]
            if self.last.exists():
                before = self.last.get()[0]
                if before != value:
                    out.append((key[0], place[0], before, value))
            self.last.update((value,))
            self.waiting.removeKey(place)
        yield pd.DataFrame(out, columns=["key", "us", "old_value", "new_value"])


def ordered_changes(events: DataFrame, key: str, at: str, field: str, tie: str, late: str) -> DataFrame:
    """(key, at, old_value, new_value) whenever an entity's field changes, in event time: whatever order rows come in, a change is
    told once the watermark has passed it, against the row before it in time (equal times: by ``tie``, a long that tells rows
    apart). Rows later than the watermark are dropped. An entity's first row changes nothing; null is a value. A row that comes
    twice counts once. State holds what waits for the watermark, and the last value; it needs the RocksDB store."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.select(F.col(key).cast("long").alias("entity"), F.col(at).cast("timestamp").alias("at"), F.col(field).cast("string").alias("value"), F.col(tie).cast("long").alias("event")).filter("at IS NOT NULL AND event IS NOT NULL")
    rows = rows.withColumn("us", F.unix_micros("at")).withWatermark("at", late)
    found = rows.groupBy("entity").transformWithStateInPandas(OrderedChanges(), "key long, us long, old_value string, new_value string", "append", "EventTime")
    return found.select(F.col("key").alias(key), F.timestamp_micros("us").alias(at), "old_value", "new_value")


def refresh_periods(stream: DataFrame, base: Callable[[], DataFrame], build: Callable[[DataFrame], DataFrame], period: str, path: str, checkpoint: str):
    """Keep a table by ``period`` up to date: what has landed since the last run names the periods, and each of these is built again from
    ``base()``, all that has landed, and replaces its own partition. A batch that runs again writes the same; other partitions
    are not touched. ``build`` keeps the column ``period``. Returns the query, which ends when all is read."""

    def write(batch: DataFrame, _: int) -> None:
        touched = batch.select(period).distinct()
        rows = build(base().join(F.broadcast(touched) if touched.count() <= MOST_PERIODS else touched, period, "left_semi"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(stream: DataFrame, table: Table, key: Sequence[str], order: Sequence[str], checkpoint: str):
    """Keep the latest row of each key in ``table``; a batch that runs again leaves the same table."""
    from ..operators.asof import first_by

    def write(batch: DataFrame, _: int) -> None:
        table.upsert(first_by(batch, list(key), [F.desc(o) for o in order]), key)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
