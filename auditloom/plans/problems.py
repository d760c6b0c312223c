"""Queries of the general problems 3 and 6."""

from __future__ import annotations

from auditloom.operators import event_features
from auditloom.streaming import sessions
from auditloom.tables import table

def _types_long(spark, d):
    logs, tools = table(spark, d, "audit_logs"), table(spark, d, "tool_intents")
    return event_features.sparse_counts(logs, tools).drop("idx")


QUERIES = {
    "p3_features": lambda s, d: event_features.feature_table(table(s, d, "audit_logs"), table(s, d, "tool_intents")),
    "p3_sparse": _types_long,
    "p6_found": lambda s, d: sessions.sessionize(table(s, d, "audit_logs")).select("user_id", "start_us", "end_us"),
    "p6_sessions": lambda s, d: sessions.sessionize(table(s, d, "audit_logs")),
}

_CALLS = """
calls AS (SELECT user_id, us, max(d) AS d FROM (
  SELECT user_id, epoch_us("timestamp") AS us, coalesce('r' || request_id, 'i' || id) AS call, coalesce(duration_ms, 0) AS d
  FROM audit_logs WHERE "timestamp" IS NOT NULL) GROUP BY user_id, us, call),
marked AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= 1800000000 THEN 0 ELSE 1 END AS new FROM calls),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM marked)
"""

_CANON = "regexp_replace(lower(trim({0})), '[\\s\\-.]+', '_', 'g')"
_TYPED = f"""
once AS (SELECT user_id, type, us, max(ms) AS ms, max(anomaly) AS anomaly FROM (
  SELECT user_id, coalesce('r' || request_id, 'i' || id) AS call, epoch_us("timestamp") AS us, coalesce(duration_ms, 0) AS ms, coalesce(anomaly_detected, false)::INT AS anomaly,
    CASE WHEN {_CANON.format('status')} IN ('success', 'denied', 'error') AND {_CANON.format('tool_name')} IN (SELECT {_CANON.format('tool_name')} FROM tool_intents)
      THEN {_CANON.format('tool_name')} || '__' || {_CANON.format('status')} ELSE 'other' END AS type
  FROM audit_logs) GROUP BY user_id, call, us, type),
sparse AS (SELECT user_id, type, count(*) AS n, sum(ms)::BIGINT AS ms, sum(anomaly)::BIGINT AS anomalies, max(us) AS last_us FROM once GROUP BY user_id, type)
"""

ORACLES = {
    "p3_sparse": f"WITH {_TYPED} SELECT * FROM sparse",
    "p6_found": f"WITH {_CALLS} SELECT user_id, min(us) AS start_us, max(us) AS end_us FROM numbered GROUP BY user_id, k",
    "p6_sessions": f"WITH {_CALLS} SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_calls, sum(d)::BIGINT AS duration_ms FROM numbered GROUP BY user_id, k",
}
