"""Sliding-window admission with memory: a call is admitted only while the admitted calls of the last minute, hour and
day stay below the limits; denied calls leave no trace, so the decision is recursive and no window frame can express it.

The state of a user are the admitted times of the last day, bounded by the daily limit. Calls are streamed span by
span of time, one micro-batch each, so a task holds no more of a user than a span. Ties are taken in order of id.
Rows without user or time are not judged.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auditloom.session import staging_path

HORIZONS = (60_000_000, 3_600_000_000, 86_400_000_000)
INPUT = "user_id string, id bigint, us bigint"
OUTPUT = "id bigint, admitted boolean, denied_by string"
NAMES = ("minute", "hour", "day")


def judge(times: list[int], calls: list[tuple[int, int]], limits: tuple[int, int, int]) -> tuple[list[int], list[tuple[int, bool, str | None]]]:
    """Admitted times of the last day after the calls, and (id, admitted, first limit that denied) of each."""
    held = deque(times)
    out = []
    for us, call in sorted(calls):
        while held and held[0] <= us - HORIZONS[2]:
            held.popleft()
        reason = None
        for width, limit, name in zip(HORIZONS, limits, NAMES):
            n = 0
            for t in reversed(held):
                if t <= us - width:
                    break
                n += 1
                if n >= limit:
                    break
            if n >= limit:
                reason = name
                break
        if reason is None:
            held.append(us)
        out.append((call, reason is None, reason))
    return list(held), out


def _update(limits: tuple[int, int, int]):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        calls = [(int(u), int(i)) for df in batches for u, i in zip(df["us"], df["id"])]
        held, out = judge(list(state.get[0]) if state.exists else [], calls, limits)
        state.update((held,))
        yield pd.DataFrame(out, columns=["id", "admitted", "denied_by"])

    return update


def admission(calls: DataFrame, limits: tuple[int, int, int], calls_per_span: int = 20_000_000, max_spans: int = 64) -> DataFrame:
    """id, admitted, denied_by of every call with user and time."""
    spark = calls.sparkSession
    source, out, ckpt = (staging_path(spark, n) for n in ("calls", "admission", "admission-state"))
    rows = calls.where("us IS NOT NULL AND user_id IS NOT NULL").select("user_id", "id", "us")
    first, last, n = rows.agg(F.min("us"), F.max("us"), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], OUTPUT)
    spans = min(max_spans, 1 + n // calls_per_span)
    length = (last - first) // spans + 1
    for k in range(spans):
        lo = first + k * length
        rows.where((F.col("us") >= lo) & (F.col("us") < lo + length)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(INPUT).parquet(source)
        judged = stream.groupBy("user_id").applyInPandasWithState(_update(limits), OUTPUT, "t array<bigint>", "append", GroupStateTimeout.NoTimeout)
        q = judged.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    return spark.read.schema(OUTPUT).parquet(out)
