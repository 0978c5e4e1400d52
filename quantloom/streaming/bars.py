"""Streams of ticks: bars, latest values, triggers and alerts. The same functions work on batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: How late a tick may come; the engine's own choice.
LATENESS = "1 minute"


def read_ticks(spark: SparkSession, path: str, schema: StructType, most_files: int = 8) -> DataFrame:
    """A stream of parquet files of events as ticks: code, ts, price."""
    return ticks(spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path))


def ticks(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("code"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"), "event_type")


def bars(t: DataFrame, width: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """code, start, open, high, low, close, n of each window; on a stream a bar ends when the watermark passes it."""
    at = F.struct("ts", "event_id")
    if t.isStreaming:
        t = t.withWatermark("ts", lateness)
    out = t.groupBy(F.window("ts", width).alias("w"), "code").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("n")
    )
    return out.select("code", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")


def latest(t: DataFrame) -> DataFrame:
    """code, ts, price of each code's last tick (update mode on a stream)."""
    best = t.groupBy("code").agg(F.max_by(F.struct("ts", "price"), F.struct("ts", "event_id")).alias("r"))
    return best.select("code", "r.ts", "r.price")


def sessions(t: DataFrame, gap: str = "6 hours", lateness: str = LATENESS) -> DataFrame:
    """code, start, stop, n, total of runs of ticks with no longer gap."""
    if t.isStreaming:
        t = t.withWatermark("ts", lateness)
    out = t.groupBy(F.session_window("ts", gap).alias("w"), "code").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))
    return out.select("code", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "total")


def every(t: DataFrame, k: int = 3) -> DataFrame:
    """code, nth, last_ts, mean of each k ticks in a row of a code; a rest of fewer waits (batch form)."""
    n = F.row_number().over(Window.partitionBy("code").orderBy("ts", "event_id"))
    group = t.withColumn("nth", F.floor((n - 1) / k)).groupBy("code", "nth").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"), F.avg("price").alias("mean"))
    return group.where(F.col("n") == k).drop("n")


class _InOrder(StatefulProcessor):
    """Of each code: ticks that wait for the watermark, in whatever micro-batch they came, and what is left of the last trigger."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts timestamp, event_id long, price double")
        self.open = handle.getValueState("open", "nth long, prices array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for ts, event_id, price in part[["ts", "event_id", "price"]].itertuples(index=False):
                self.waiting.appendValue((ts.to_pydatetime(), int(event_id), float(price)))
                self.handle.registerTimer(_millis(ts))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1]))
        ready = [r for r in waiting if _millis(pd.Timestamp(r[0])) <= done]
        if not ready:
            return
        nth, held = self.open.get() if self.open.exists() else (0, [])
        held, out = list(held), []
        for ts, _, price in ready:
            held.append(price)
            if len(held) == self.k:
                out.append((key[0], nth, ts, sum(held) / self.k))
                nth, held = nth + 1, []
        self.open.update((nth, held))
        if len(ready) < len(waiting):
            self.waiting.put(waiting[len(ready) :])
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=["code", "nth", "last_ts", "mean"])

    def close(self) -> None:
        pass


class _Recent(StatefulProcessor):
    """Of each code: its last n ticks by time, whenever they came."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "ts timestamp, event_id long, price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ticks = [tuple(r) for r in self.last.get()] if self.last.exists() else []
        for part in rows:
            ticks += [(ts.to_pydatetime(), int(i), float(p)) for ts, i, p in part[["ts", "event_id", "price"]].itertuples(index=False)]
            ticks = sorted(ticks, key=lambda r: (r[0], r[1]))[-self.n :]
        self.last.put(ticks)
        yield pd.DataFrame([(key[0], k, *r) for k, r in enumerate(reversed(ticks), 1)], columns=["code", "nth", "ts", "event_id", "price"])

    def close(self) -> None:
        pass


def _millis(ts: pd.Timestamp) -> int:
    """Milliseconds since 1970, rounded up."""
    return -(-ts.value // 1_000_000)


def every_stream(t: DataFrame, k: int = 3, lateness: str = LATENESS) -> DataFrame:
    """The same on a stream, append mode: ticks wait in state until the watermark passes them, so that those that come late, in a later micro-batch, fall in order.

    State holds a code's ticks within the lateness, at most k - 1 prices and the number of its next trigger; a timer for each tick's time. Ticks later than
    `lateness` are dropped by the engine; what the watermark hasn't passed waits. Needs RocksDB as the state store (session sets it).
    """
    return t.withWatermark("ts", lateness).groupBy("code").transformWithStateInPandas(_InOrder(k), "code long, nth long, last_ts timestamp, mean double", "append", "eventTime")


def recent(t: DataFrame, n: int = 5) -> DataFrame:
    """code, nth, ts, event_id, price of each code's last n ticks, the latest first (batch form)."""
    nth = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("ts"), F.desc("event_id")))
    return t.withColumn("nth", nth).where(F.col("nth") <= n).select("code", "nth", "ts", "event_id", "price")


def recent_stream(t: DataFrame, n: int = 5) -> DataFrame:
    """The same on a stream, update mode: after each micro-batch the last n ticks of every code that got some. State holds n ticks a code."""
    return t.groupBy("code").transformWithStateInPandas(_Recent(n), "code long, nth int, ts timestamp, event_id long, price double", "update", "none")


def alerts(t: DataFrame, high: float) -> DataFrame:
    """Ticks above a level, or of errors."""
    return t.withColumn("reason", F.when(F.col("price") > high, "price").when(F.col("event_type") == "error", "error")).where("reason IS NOT NULL")


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet"):
    """Writes all that is there now, then ends: for scheduled runs."""
    return df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
