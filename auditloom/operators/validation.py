"""Row validation: named conditions over columns, and the names of those that a row breaks, in order.

Conditions are data in the common part of SQL, so the same text runs in Spark and in a SQL check. A condition that is
null (a column it needs is null) is not broken; presence is a condition of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    name: str
    condition: str


CALL_CHECKS = (
    Check("user_missing", "user_id IS NOT NULL AND user_id <> ''"), Check("tool_missing", "tool IS NOT NULL AND tool <> ''"), Check("time_missing", "us IS NOT NULL"),
    Check("status_unknown", "state IN ('success', 'denied', 'error')"), Check("duration_negative", "duration_ms >= 0"), Check("score_range", "anomaly_score BETWEEN 0 AND 1"), Check("confidence_range", "intent_confidence BETWEEN 0 AND 1"),
    Check("reason_missing", "state <> 'denied' OR deny_reason IS NOT NULL"), Check("flag_without_score", "NOT anomaly_detected OR anomaly_score IS NOT NULL"),
)
CHUNK_CHECKS = (
    Check("path_missing", "file_path IS NOT NULL AND file_path <> ''"), Check("start_line", "start_line >= 1"), Check("line_order", "end_line >= start_line"), Check("name_missing", "chunk_type NOT IN ('function', 'class') OR name IS NOT NULL"),
    Check("docstring_long", "length(docstring) <= 500"), Check("time_missing", "indexed_at IS NOT NULL"),
)


def with_errors(df: DataFrame, checks) -> DataFrame:
    """All rows with ``errors``, an array of the names of the broken checks."""
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(F.expr(f"NOT ({c.condition})"), c.name) for c in checks])))


def invalid(df: DataFrame, key: str, checks) -> DataFrame:
    """key and the names of the broken checks of rows that break any."""
    return with_errors(df, checks).where(F.size("errors") > 0).select(key, F.array_join("errors", ",").alias("errors"))


def sql_errors(checks) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({c.condition}) THEN '{c.name}' END" for c in checks) + ")"
