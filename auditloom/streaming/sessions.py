"""Problem 6: activity grouped into sessions by keyed event-time timers.

``session_stream`` is the streaming operator: fragments of activity (a single event is a fragment of one) arrive
per user; each opens a session, extends one, or joins two, and resets the inactivity timeout; when the event-time
timer of a user expires, the sessions that are past it are emitted for good with start, end and count.

``sessionize`` runs it over a stored table. Events of one user inside one slot of the length of the gap always
belong to one session, so they are first folded to one fragment per user and slot, with map-side combine:
a service account with a third of all rows becomes one row per slot. Fragments are staged in the shared folder,
large ones span by span of time, closed by a clock row behind the last event that lets every timer expire, and
streamed in micro-batches with a watermark of one span; state and output live in the shared folder, so a lost
executor costs a retry.

A second delivery of a call (same request_id, user and time) counts once.
Defined cases: rows without timestamp are ignored; a null user_id is a user of its own; a null request_id makes
a call of its own; equal timestamps belong together; a gap of exactly the timeout does not end a session; empty tables
give no sessions; session_id is not used; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auditloom.session import staging_path

GAP_US = 1_800_000_000
FRAGMENT = "user_id string, ts timestamp, start_us bigint, end_us bigint, n_calls bigint, duration_ms bigint"
SESSION = "user_id string, start_us bigint, end_us bigint, n_calls bigint, duration_ms bigint"
STATE = "s array<bigint>, e array<bigint>, n array<bigint>, d array<bigint>"
CLOCK = "\x00clock"  # no user of this name: ids are printable


def _fold(open_sessions: list[list[int]], fragments: list[tuple], gap: int) -> list[list[int]]:
    """Sessions (start, end, calls, duration) after the fragments, in order of start."""
    rows = sorted([*map(list, open_sessions), *map(list, fragments)])
    out: list[list[int]] = []
    for s, e, n, d in rows:
        if out and s - out[-1][1] <= gap:
            last = out[-1]
            last[1], last[2], last[3] = max(last[1], e), last[2] + n, last[3] + d
        else:
            out.append([s, e, n, d])
    return out


def _update(gap: int):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        if not state.hasTimedOut:
            for df in batches:
                held = _fold(held, list(zip(df["start_us"], df["end_us"], df["n_calls"], df["duration_ms"])), gap)
        mark = state.getCurrentWatermarkMs() * 1000
        done = [x for x in held if x[1] + gap < mark]
        live = [x for x in held if x[1] + gap >= mark]
        if live:
            state.update(tuple([int(v) for v in c] for c in zip(*live)))
            # the next timer: inactivity of the session that ended first
            state.setTimeoutTimestamp(max((min(x[1] for x in live) + gap) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if done and key[0] != CLOCK:
            yield pd.DataFrame([(key[0], *map(int, x)) for x in done], columns=["user_id", "start_us", "end_us", "n_calls", "duration_ms"])

    return update


def session_stream(fragments: DataFrame, gap_us: int = GAP_US, lateness: str = "2 days") -> DataFrame:
    """Streaming sessions of a streaming DataFrame of fragments; rows may be late by ``lateness``."""
    return (
        fragments.withWatermark("ts", lateness)
        .groupBy("user_id")
        .applyInPandasWithState(_update(gap_us), SESSION, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def fragments_of(events: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """One fragment per user and slot of the gap's length, every call counted once."""
    us = F.unix_micros("timestamp")
    call = F.coalesce(F.concat(F.lit("r"), "request_id"), F.concat(F.lit("i"), F.col("id").cast("string")))
    calls = events.where("timestamp IS NOT NULL").select(
        "user_id", us.alias("us"), F.floor(us / F.lit(gap_us)).cast("bigint").alias("slot"), call.alias("call"), F.coalesce("duration_ms", F.lit(0)).cast("bigint").alias("d")
    )
    once = calls.groupBy("user_id", "slot", "us", "call").agg(F.max("d").alias("d"))
    return once.groupBy("user_id", "slot").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n_calls"), F.sum("d").alias("duration_ms"))


def sessionize(events: DataFrame, gap_us: int = GAP_US, fragments_per_batch: int = 20_000_000, max_spans: int = 64) -> DataFrame:
    """user_id, start_us, end_us, n_calls, duration_ms of every session of a stored table of events."""
    spark = events.sparkSession
    staged, out, ckpt = (staging_path(spark, n) for n in ("fragments", "sessions", "session-state"))
    frags = fragments_of(events, gap_us).select("user_id", F.timestamp_micros("end_us").alias("ts"), "start_us", "end_us", "n_calls", "duration_ms")
    frags.write.parquet(staged)
    stored = spark.read.schema(FRAGMENT).parquet(staged)
    first, last, n = stored.agg(F.min("end_us"), F.max("end_us"), F.count(F.lit(1))).first()
    if last is None:
        return spark.createDataFrame([], SESSION)
    spans = min(max_spans, 1 + n // fragments_per_batch)
    length = (last - first) // spans + 1
    files = None
    if spans > 1:
        # one write per span of time: files are streamed by their age, so nothing in a later batch is older than one span
        ordered = staging_path(spark, "fragments-in-order")
        for k in range(spans):
            lo = first + k * length
            stored.where((F.col("end_us") >= lo) & (F.col("end_us") < lo + length)).write.mode("append").parquet(ordered)
        files = max(1, len(spark.read.parquet(ordered).inputFiles()) // spans)
        staged = ordered
    late = 0 if spans == 1 else length // 1_000_000 + 1
    clock = last + 4 * gap_us + 2 * late * 1_000_000 + 86_400_000_000
    spark.createDataFrame([(CLOCK, clock)], "user_id string, us bigint").select(
        "user_id", F.timestamp_micros("us").alias("ts"), F.col("us").alias("start_us"), F.col("us").alias("end_us"), F.lit(0).cast("bigint").alias("n_calls"), F.lit(0).cast("bigint").alias("duration_ms")
    ).coalesce(1).write.mode("append").parquet(staged)
    reader = spark.readStream.schema(FRAGMENT)
    source = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(staged)
    q = session_stream(source, gap_us, f"{late} seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(SESSION).parquet(out)
