"""Streaming twins of the session, rate-limit and daily operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def source(spark: SparkSession, path: str, schema: str, ts: str) -> DataFrame:
    """Parquet files as a stream; a timestamp without zone becomes one in the session's zone (UTC), as watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def sessions(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions, each once it can't grow any more (append mode)."""
    rows = stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.min(ts).alias("started"), F.max(ts).alias("last_hit"), F.count("*").alias("hits"))
    return rows.drop("session_window")


def daily_counts(stream: DataFrame, ts: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day")).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "n")


def once(stream: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Drop events delivered again within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


class _Walk(StatefulProcessor):
    """A key's rows in order, with a state of two numbers in hand and a timer at which it goes."""

    def __init__(self, names: list[str], step, ts: str, tie: str):
        self.names, self.step, self.ts, self.tie = names, step, ts, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "a long, b long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        state = self.held.get() if self.held.exists() else None
        made = []
        for own in pd.concat(list(rows)).sort_values([self.ts, self.tie]).to_dict("records"):
            state, out = self.step(state, own[self.ts].value // 1000, own)
            made.append((own[self.tie], key[0], *out))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state is None:
            self.held.clear()
        else:
            self.held.update(state[:2])
            self.handle.registerTimer(max(state[2] // 1000, timers.getCurrentWatermarkInMs()) + 1)
        yield pd.DataFrame(made, columns=self.names)

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame(columns=self.names)

    def close(self) -> None:
        pass


def _walked(stream: DataFrame, key: str, ts: str, tie: str, step, columns: str, late: str) -> DataFrame:
    """Rows of each key through step(state, micros, row) -> (state with when it goes, output), in RocksDB, so that keys are bounded
    by disk and a restart goes on where the last run ended. Rows that come after later ones of their key were decided on are
    decided on by the state as it is then."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = f"{tie} {kinds[tie]}, {key} {kinds[key]}, {columns}"
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    return stream.withWatermark(ts, late).groupBy(key).transformWithStateInPandas(_Walk(names, step, ts, tie), schema, "Append", "EventTime")


def rate_limited(stream: DataFrame, key: str, ts: str, tie: str, limit: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """Decisions of the anchored rate limit; state is a window's start and count per key, and goes by a timer once the watermark
    has passed the window."""
    span = seconds * 1_000_000

    def step(state: tuple | None, t: int, row: dict) -> tuple:
        start, n = state[:2] if state else (t, 0)
        start, n = (t, 1) if start + span < t else (start, n + 1)
        return (start, n, start + span), (n, n <= limit)

    return _walked(stream, key, ts, tie, step, "count_in_window int, allowed boolean", late)


def cooled_down(stream: DataFrame, key: str, ts: str, tie: str, exhausted: str, minutes: int = 20, late: str = "1 hour") -> DataFrame:
    """Which attempts at a provider are skipped because its quota was found exhausted less than `minutes` before; state is when
    the rest ends, and goes by a timer once the watermark has passed it."""
    span = minutes * 60_000_000

    def step(state: tuple | None, t: int, row: dict) -> tuple:
        until = state[0] if state else None
        skipped = until is not None and t < until
        until = until if skipped else t + span if row[exhausted] else None
        return (until, 0, until) if until is not None else None, (skipped,)

    return _walked(stream, key, ts, tie, step, "resting boolean", late)


def write_batches(stream: DataFrame, folder: str, checkpoint: str, once_only: bool = True):
    """Append-only sink with a subfolder for each batch: a batch that runs again replaces itself, so two tables written in it never differ."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once_only else writer).start()
