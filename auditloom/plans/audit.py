"""Queries of the audit store and the time series, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import audit as A
from auditloom.operators import timeseries as TS
from auditloom.tables import table

AS_OF = 1517356800000000  # 2018-01-31 00:00 UTC
FIRST = 1514764800000000  # 2018-01-01 00:00 UTC
BOUNDS = [10, 25, 50, 100, 250, 500, 1000, 2500, 5000]

CANON = "regexp_replace(lower(trim({0})), '[\\s\\-.]+', '_', 'g')"
CALLS = f"""calls AS (SELECT id, user_id, client_id, {CANON.format('tool_name')} AS tool, {CANON.format('status')} AS state, epoch_us("timestamp") AS us, duration_ms, ip_address, session_id, request_id,
  deny_reason, tool_input, tool_output_sanitized, intent_confidence, anomaly_score, anomaly_detected FROM audit_logs)"""


def c(s, d):
    return A.calls(table(s, d, "audit_logs"))


def _hourly(s, d, *by):
    return TS.rate(c(s, d), TS.HOUR, *by).select(*by, "slot_us", "n")


def _errors(s, d):
    e = F.count_if(F.col("state") == "error")
    return c(s, d).groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.try_divide(e * F.lit(100.0), F.count(F.lit(1))), F.lit(0.0)), 6).alias("error_percent"))


def _lasting(s, d):
    per = c(s, d).where("us IS NOT NULL").groupBy(TS.slot(TS.HOUR).alias("slot_us")).agg((F.avg("duration_ms") > 120).alias("firing"))
    return TS.lasting(per.withColumn("all", F.lit("all")), TS.HOUR, 3, "all").drop("all")


def _imbalance(s, d):
    per = c(s, d).groupBy("client_id").agg(F.avg("anomaly_score").alias("a"))
    return per.agg(F.round(F.max("a") - F.min("a"), 6).alias("spread"), F.count("a").alias("n_clients"))


SLIM = ["id", "user_id", "tool", "state", "us"]

QUERIES = {
    "activity_summary": lambda s, d: A.activity_summary(c(s, d)),
    "audit_scan": lambda s, d: c(s, d).select(*SLIM),
    "audit_filter": lambda s, d: A.matching(c(s, d), state="denied", since=FIRST + 5 * A.DAY, until=FIRST + 20 * A.DAY, min_anomaly_score=0.1).select(*SLIM, "anomaly_score"),
    "audit_filter_flag": lambda s, d: A.matching(c(s, d), anomaly_detected=False, client_id="desk-bridge").select(*SLIM),
    "audit_ip_hash": lambda s, d: c(s, d).where("ip_address IS NOT NULL").groupBy(F.substring(F.sha2("ip_address", 256), 1, 16).alias("ip_hash")).agg(F.count(F.lit(1)).alias("n")),
    "recent_calls": lambda s, d: A.recent(c(s, d), AS_OF, 24).select(*SLIM),
    "logs_by_tool": lambda s, d: A.matching(A.recent(c(s, d), AS_OF, 240), tool="diff_index").select(*SLIM),
    "anomaly_rows": lambda s, d: A.matching(c(s, d), anomaly_detected=True).select(*SLIM, "anomaly_score"),
    "audit_rls": lambda s, d: A.visible_to(c(s, d), "usr_0000001", False).select(*SLIM),
    "audit_count": lambda s, d: A.matching(c(s, d), state="success").agg(F.count(F.lit(1)).alias("n")),
    "audit_page": lambda s, d: A.page(c(s, d), 3, 50).select(*SLIM),
    "status_counts": lambda s, d: c(s, d).groupBy("state").agg(F.count(F.lit(1)).alias("n")),
    "status_rollup": lambda s, d: c(s, d).rollup("client_id", "state").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level")),
    "distinct_tools": lambda s, d: c(s, d).groupBy("user_id").agg(F.count_distinct("tool").alias("n_tools"), F.count_distinct("ip_address").alias("n_ips")),
    "distinct_clients": lambda s, d: c(s, d).select("client_id").where("client_id IS NOT NULL").distinct(),
    "top_tools": lambda s, d: A.top_per_group(c(s, d).groupBy("user_id", "tool").agg(F.count(F.lit(1)).alias("n")), ["user_id"], 5, F.col("n").desc(), F.col("tool")),
    "avg_duration": lambda s, d: c(s, d).groupBy("tool").agg(F.nullif(F.round(F.avg("duration_ms"), 2), F.lit(0.0)).alias("avg_ms")),
    "retention_stats": lambda s, d: A.retention_stats(c(s, d), AS_OF, 14),
    "retention_keep": lambda s, d: A.retention_split(c(s, d), AS_OF, 14)[0].select(*SLIM),
    "archive_rows": lambda s, d: A.retention_split(c(s, d), AS_OF, 14)[1].select(*SLIM),
    "export_csv": lambda s, d: A.as_csv(A.matching(c(s, d), since=FIRST, until=FIRST + 7 * A.DAY), ("id", "user_id", "client_id", "tool", "state", "us", "duration_ms", "request_id")),
    "export_json": lambda s, d: A.as_json(A.matching(c(s, d), since=FIRST, until=FIRST + 7 * A.DAY), ("id", "user_id", "tool", "state", "us", "duration_ms")),
    "content_hash": lambda s, d: table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5")),
    "daily_active": lambda s, d: c(s, d).where("us IS NOT NULL").groupBy(TS.slot(A.DAY).alias("day_us")).agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("n")),
    "denied_reasons": lambda s, d: c(s, d).where("state = 'denied'").groupBy("tool", "deny_reason").agg(F.count(F.lit(1)).alias("n")),
    "second_deliveries": lambda s, d: c(s, d).where("request_id IS NOT NULL").groupBy("request_id", "user_id", "us").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1").select("request_id", "n", "first_id"),
    "rate_5m": lambda s, d: TS.rate(c(s, d), 300_000_000),
    "increase_1h": lambda s, d: TS.rate(c(s, d), TS.HOUR, "tool").select("slot_us", "tool", "n"),
    "sum_by_label": lambda s, d: c(s, d).groupBy("client_id").agg(F.sum(F.col("duration_ms").cast("bigint")).alias("ms"), F.count(F.lit(1)).alias("n")),
    "tumbling_counts": lambda s, d: TS.rate(c(s, d), 6 * TS.HOUR, "state").select("slot_us", "state", "n"),
    "sliding_counts": lambda s, d: TS.sliding(c(s, d), 6 * TS.HOUR, TS.HOUR),
    "latency_heatmap": lambda s, d: TS.cumulative_buckets(c(s, d), "duration_ms", BOUNDS, "tool"),
    "hist_quantile": lambda s, d: TS.histogram_quantile(TS.cumulative_buckets(c(s, d), "duration_ms", BOUNDS, "tool"), 0.95, "tool"),
    "hist_median": lambda s, d: TS.histogram_quantile(TS.cumulative_buckets(c(s, d), "duration_ms", BOUNDS, "client_id"), 0.5, "client_id"),
    "topk_tools": lambda s, d: c(s, d).groupBy("tool").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "tool").limit(10),
    "error_rate": _errors,
    "alert_spike": lambda s, d: TS.spikes(_hourly(s, d, "client_id").where("client_id IS NOT NULL"), 3.0, "client_id"),
    "alert_drift": lambda s, d: TS.drift(TS.dense_hours(_hourly(s, d, "tool"), "tool"), 24, 4.0, "tool"),
    "alert_imbalance": _imbalance,
    "avg_vs_global": lambda s, d: TS.against_global(c(s, d), "anomaly_score", 1.2, "tool"),
    "alert_for_duration": _lasting,
    "event_rates": lambda s, d: table(s, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.unix_micros(F.col("h").cast("timestamp")).alias("slot_us"), "n", "total"),
}

_SLIM = "id, user_id, tool, state, us"
W = f"WITH {CALLS} "
_HOURLY = "hourly AS (SELECT {by}, us // 3600000000 * 3600000000 AS slot_us, count(*) AS n FROM calls WHERE us IS NOT NULL GROUP BY ALL)"
_BUCKETS = "buckets AS (SELECT {by}, le, (SELECT count(*) FROM calls c2 WHERE c2.{by} IS NOT DISTINCT FROM k.{by} AND c2.duration_ms <= le) AS n FROM (SELECT DISTINCT {by} FROM calls WHERE duration_ms IS NOT NULL) k, (SELECT unnest([10.0, 25, 50, 100, 250, 500, 1000, 2500, 5000, 1e308]::DOUBLE[]) AS le))"
_QUANTILE = """, x AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(n) OVER w, 0) AS below, max(n) OVER (PARTITION BY {by}) AS total FROM buckets WINDOW w AS (PARTITION BY {by} ORDER BY le)),
hit AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY le) AS first FROM x WHERE n >= total * {q} AND total > 0)
SELECT {by}, round(CASE WHEN le >= 1e308 THEN lo ELSE coalesce(lo + (le - lo) * ((total * {q} - below) / nullif(n - below, 0)), le) END, 4) AS value FROM hit WHERE first = 1"""
_BLANK = "CASE WHEN {0} IS NULL OR CAST({0} AS VARCHAR) IN ('0', '0.0', '') THEN '' ELSE CAST({0} AS VARCHAR) END"

ORACLES = {
    "activity_summary": W + """SELECT user_id, count(*) AS total, count(*) FILTER (state = 'success') AS n_success, count(*) FILTER (state = 'denied') AS n_denied, count(*) FILTER (state = 'error') AS n_error,
  count(*) FILTER (anomaly_detected) AS n_anomalies, nullif(round(avg(duration_ms), 2), 0) AS avg_duration_ms, min(us) AS first_us, max(us) AS last_us, count(DISTINCT tool) AS n_tools,
  (SELECT tool FROM calls c2 WHERE c2.user_id = calls.user_id GROUP BY tool ORDER BY count(*) DESC, tool DESC LIMIT 1) AS top_tool, count(DISTINCT ip_address) AS n_ips FROM calls GROUP BY user_id""",
    "audit_scan": W + f"SELECT {_SLIM} FROM calls",
    "audit_filter": W + f"SELECT {_SLIM}, anomaly_score FROM calls WHERE state = 'denied' AND us BETWEEN {FIRST + 5 * A.DAY} AND {FIRST + 20 * A.DAY} AND anomaly_score >= 0.1",
    "audit_filter_flag": W + f"SELECT {_SLIM} FROM calls WHERE anomaly_detected = false AND client_id = 'desk-bridge'",
    "audit_ip_hash": "SELECT substr(sha256(ip_address), 1, 16) AS ip_hash, count(*) AS n FROM audit_logs WHERE ip_address IS NOT NULL GROUP BY 1",
    "recent_calls": W + f"SELECT {_SLIM} FROM calls WHERE us > {AS_OF - A.DAY}",
    "logs_by_tool": W + f"SELECT {_SLIM} FROM calls WHERE us > {AS_OF - 10 * A.DAY} AND tool = 'diff_index'",
    "anomaly_rows": W + f"SELECT {_SLIM}, anomaly_score FROM calls WHERE anomaly_detected",
    "audit_rls": W + f"SELECT {_SLIM} FROM calls WHERE user_id = 'usr_0000001'",
    "audit_count": W + "SELECT count(*) AS n FROM calls WHERE state = 'success'",
    "audit_page": W + f"SELECT {_SLIM} FROM calls ORDER BY us DESC NULLS LAST, id DESC LIMIT 50 OFFSET 100",
    "status_counts": W + "SELECT state, count(*) AS n FROM calls GROUP BY 1",
    "status_rollup": W + "SELECT client_id, state, count(*) AS n, grouping(client_id, state) AS level FROM calls GROUP BY ROLLUP (client_id, state)",
    "distinct_tools": W + "SELECT user_id, count(DISTINCT tool) AS n_tools, count(DISTINCT ip_address) AS n_ips FROM calls GROUP BY 1",
    "distinct_clients": "SELECT DISTINCT client_id FROM audit_logs WHERE client_id IS NOT NULL",
    "top_tools": W + "SELECT * FROM (SELECT user_id, tool, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, tool) AS rank FROM (SELECT user_id, tool, count(*) AS n FROM calls GROUP BY ALL)) WHERE rank <= 5",
    "avg_duration": W + "SELECT tool, nullif(round(avg(duration_ms), 2), 0) AS avg_ms FROM calls GROUP BY 1",
    "retention_stats": W + f"SELECT count(*) AS total, count(*) FILTER (us < {AS_OF - 14 * A.DAY}) AS expiring, min(us) AS oldest_us, max(us) AS newest_us FROM calls",
    "retention_keep": W + f"SELECT {_SLIM} FROM calls WHERE us >= {AS_OF - 14 * A.DAY} OR us IS NULL",
    "archive_rows": W + f"SELECT {_SLIM} FROM calls WHERE us < {AS_OF - 14 * A.DAY}",
    "export_csv": W + "SELECT id, concat_ws(',', " + ", ".join(_BLANK.format(x) for x in ("id", "user_id", "client_id", "tool", "state", "us", "duration_ms", "request_id")) + f") AS line FROM calls WHERE us BETWEEN {FIRST} AND {FIRST + 7 * A.DAY}",
    "export_json": W + f"""SELECT id, '{{"id":' || id || ',"user_id":"' || user_id || '","tool":"' || tool || '","state":"' || state || '","us":' || us || CASE WHEN duration_ms IS NULL THEN '' ELSE ',"duration_ms":' || duration_ms END || '}}' AS line FROM calls WHERE us BETWEEN {FIRST} AND {FIRST + 7 * A.DAY}""",
    "content_hash": "SELECT doc_id, sha256(text) AS sha, md5(text) AS md5 FROM documents",
    "daily_active": W + "SELECT us // 86400000000 * 86400000000 AS day_us, count(DISTINCT user_id) AS users, count(*) AS n FROM calls WHERE us IS NOT NULL GROUP BY 1",
    "denied_reasons": W + "SELECT tool, deny_reason, count(*) AS n FROM calls WHERE state = 'denied' GROUP BY ALL",
    "second_deliveries": W + "SELECT request_id, count(*) AS n, min(id) AS first_id FROM calls WHERE request_id IS NOT NULL GROUP BY request_id, user_id, us HAVING count(*) > 1",
    "rate_5m": W + "SELECT us // 300000000 * 300000000 AS slot_us, count(*) AS n, round(count(*) / 300.0, 6)::DOUBLE AS per_second FROM calls WHERE us IS NOT NULL GROUP BY 1",
    "increase_1h": W + "SELECT us // 3600000000 * 3600000000 AS slot_us, tool, count(*) AS n FROM calls WHERE us IS NOT NULL GROUP BY ALL",
    "sum_by_label": W + "SELECT client_id, sum(duration_ms)::BIGINT AS ms, count(*) AS n FROM calls GROUP BY 1",
    "tumbling_counts": W + "SELECT us // 21600000000 * 21600000000 AS slot_us, state, count(*) AS n FROM calls WHERE us IS NOT NULL GROUP BY ALL",
    "sliding_counts": W + "SELECT (us // 3600000000 - k) * 3600000000 AS slot_us, count(*) AS n FROM calls, range(0, 6) t(k) WHERE us IS NOT NULL GROUP BY 1",
    "latency_heatmap": W + ", " + _BUCKETS.format(by="tool") + " SELECT * FROM buckets",
    "hist_quantile": W + ", " + _BUCKETS.format(by="tool") + _QUANTILE.format(by="tool", q=0.95),
    "hist_median": W + ", " + _BUCKETS.format(by="client_id") + _QUANTILE.format(by="client_id", q=0.5),
    "topk_tools": W + "SELECT tool, count(*) AS n FROM calls GROUP BY 1 ORDER BY n DESC, tool LIMIT 10",
    "error_rate": W + "SELECT tool, count(*) AS n, round(count(*) FILTER (state = 'error') * 100.0::DOUBLE / count(*), 6) AS error_percent FROM calls GROUP BY 1",
    "alert_spike": W + ", " + _HOURLY.format(by="client_id") + " SELECT a.client_id, a.slot_us, a.n, b.n AS before FROM hourly a JOIN hourly b ON a.client_id = b.client_id AND b.slot_us = a.slot_us - 3600000000 WHERE a.n > b.n * 3",
    "alert_drift": W + ", " + _HOURLY.format(by="tool") + """, grid AS (SELECT tool, slot_us FROM (SELECT DISTINCT tool FROM hourly), (SELECT unnest(range(min(slot_us), max(slot_us) + 1, 3600000000)) AS slot_us FROM hourly)),
dense AS (SELECT tool, slot_us, coalesce(n, 0) AS n FROM grid LEFT JOIN hourly USING (tool, slot_us)),
m AS (SELECT *, avg(n) OVER w AS mean, count(n) OVER w AS k FROM dense WINDOW w AS (PARTITION BY tool ORDER BY slot_us ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT tool, slot_us, n, round(mean, 6) AS mean FROM m WHERE k = 24 AND n > mean * 4 AND n > 0""",
    "avg_vs_global": W + "SELECT tool, n, round(a, 6) AS mean, round(g, 6) AS global_mean FROM (SELECT tool, count(anomaly_score) AS n, avg(anomaly_score) AS a FROM calls GROUP BY 1), (SELECT avg(anomaly_score) AS g FROM calls) WHERE a > g * 1.2",
    "alert_imbalance": W + "SELECT round(max(a) - min(a), 6) AS spread, count(a) AS n_clients FROM (SELECT client_id, avg(anomaly_score) AS a FROM calls GROUP BY 1)",
    "alert_for_duration": W + """, f AS (SELECT us // 3600000000 * 3600000000 AS slot_us FROM calls WHERE us IS NOT NULL GROUP BY 1 HAVING avg(duration_ms) > 120)
SELECT min(slot_us) AS from_us, max(slot_us) AS to_us, count(*) AS slots FROM (SELECT slot_us, slot_us - row_number() OVER (ORDER BY slot_us) * 3600000000 AS k FROM f) GROUP BY k HAVING count(*) >= 3""",
    "event_rates": "SELECT event_type, epoch_us(date_trunc('hour', ts)) AS slot_us, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
