"""Sessions by inactivity, visitors derived from them, and rate limits anchored at a key's first hit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = "30 minutes"
#: Calls allowed in a window, and its seconds, by route.
LIMITS = {
    "login": (5, 900),
    "generate": (20, 3600),
    "parse": (15, 3600),
    "conversion": (60, 60),
    "usage": (120, 60),
    "feedback": (10, 3600),
    "search": (12, 3600),
    "more": (40, 3600),
}


def sessions(hits: DataFrame, key: str, ts: str, gap: str = GAP, firsts: dict[str, str] | None = None) -> DataFrame:
    """(key, started, last_hit, hits, ...): a session ends after `gap` without a hit; hits just `gap` apart are one session.

    firsts: output name -> column whose value at the session's first hit is kept. session_window merges windows that touch,
    and aggregates partially before the shuffle.
    """
    kept = {name: F.min_by(column, ts).alias(name) for name, column in (firsts or {}).items()}
    grouped = hits.groupBy(key, F.session_window(ts, gap)).agg(F.min(ts).alias("started"), F.max(ts).alias("last_hit"), F.count("*").alias("hits"), *kept.values())
    return grouped.drop("session_window")


def visitors(visits: DataFrame, key: str, started: str = "started") -> DataFrame:
    """What repeated upserts of a visitor at each session start leave: first and last start, and their number."""
    return visits.groupBy(key).agg(F.min(started).alias("first_seen"), F.max(started).alias("last_seen"), F.count("*").alias("visit_count"))


def rate_limited(hits: DataFrame, key: str, ts: str, tie: str, limit: int, seconds: int) -> DataFrame:
    """(tie, key, window_start, count_in_window, allowed) of each hit, for windows that open at a key's first hit after the
    last one's end. A hit just at the end still counts in a window.

    Hits are sorted by key and time within their partition, and a task walks over them with the window of one key in hand,
    so a key's hits are never held together. Of hits at one instant the smaller tie comes first. Hits without a key are one key.
    """
    rows = hits.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(tie).alias("tie"), F.col(key).alias("key"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    span = seconds * 1_000_000

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, n = object(), 0, 0
        for batch in batches:
            starts, counts = [], []
            for t, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if own != key or start + span < t:
                    key, start, n = own, t, 0
                n += 1
                starts.append(start)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(starts, pa.int64()), pa.array(counts, pa.int32())], ["tie", "key", "w", "n"])

    ordered = rows.filter("t is not null").repartition("key").sortWithinPartitions("key", "t", "tie")
    walked = ordered.mapInArrow(walk, f"tie {kinds['tie']}, key {kinds['key']}, w long, n int")
    return walked.select(F.col("tie").alias(tie), F.col("key").alias(key), F.timestamp_micros("w").cast("timestamp_ntz").alias("window_start"), F.col("n").alias("count_in_window"), (F.col("n") <= limit).alias("allowed"))


def cooled_down(attempts: DataFrame, key: str, ts: str, tie: str, exhausted: str, minutes: int = 20) -> DataFrame:
    """(tie, key, resting, until) of each attempt at a provider (key): one whose quota is exhausted rests for `minutes` from that
    attempt on, and attempts in that time are skipped, whatever they would have met; one just at its end is made. until: when the
    rest that holds after the attempt ends, else null.

    Attempts are sorted by key and time within their partition, and a task walks over them with one key's rest in hand. Of
    attempts at one instant the smaller tie comes first. Attempts without a key are one key, those without a time are left out.
    """
    rows = attempts.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(tie).alias("tie"), F.col(key).alias("key"), F.coalesce(F.col(exhausted), F.lit(False)).alias("out"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    span = minutes * 60_000_000

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, until = object(), None
        for batch in batches:
            resting, ends = [], []
            for t, own, out in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if own != key:
                    key, until = own, None
                skipped = until is not None and t < until
                if not skipped:
                    until = t + span if out else None
                resting.append(skipped)
                ends.append(until)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(resting, pa.bool_()), pa.array(ends, pa.int64())], ["tie", "key", "resting", "until"])

    ordered = rows.filter("t is not null").repartition("key").sortWithinPartitions("key", "t", "tie")
    walked = ordered.mapInArrow(walk, f"tie {kinds['tie']}, key {kinds['key']}, resting boolean, until long")
    return walked.select(F.col("tie").alias(tie), F.col("key").alias(key), "resting", F.timestamp_micros("until").cast("timestamp_ntz").alias("until"))
