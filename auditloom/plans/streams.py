"""Queries on streams, sources and the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import definitions as D
from auditloom.functions import sanitize as S
from auditloom.plans.audit import c
from auditloom.sources import files
from auditloom.streaming import admission, windows
from auditloom.tables import table

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _stream(s, d):
    e = s.readStream.schema(EVENTS).parquet(f"{d}/[e]vents.parquet")  # as a pattern: a file source takes a folder or a pattern
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _events(s, d):
    return table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _pricing(s, d):
    li = table(s, d, "lineitem")
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(disc), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


def _nation_revenue(s, d):
    """Lines folded per order before the joins; customers, nations and regions follow by key."""
    per = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    o, cu, n = table(s, d, "orders"), table(s, d, "customer"), table(s, d, "nation")
    j = per.join(o, per.l_orderkey == o.o_orderkey).join(cu, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


def _files(s, d):
    ch = table(s, d, "code_chunks")
    return ch.groupBy(files.language(F.col("file_path")).alias("language")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("repo", files.normal_path(F.col("file_path"))).alias("files"))


QUERIES = {
    "stream_tumbling": lambda s, d: windows.run_available(windows.tumbling(_stream(s, d), "1 hour", "10 minutes", "event_type"), "tumbling"),
    "debounce_sessions": lambda s, d: windows.debounced(_events(s, d), "user_id", "60 minutes", "event_type"),
    "rate_limit_admission": lambda s, d: admission.admission(c(s, d), (2, 10, 40)),
    "extract_defs": lambda s, d: D.python_definitions(table(s, d, "code_chunks")),
    "sanitize_json": lambda s, d: D.sanitize_json(table(s, d, "audit_logs"), "id", "tool_input", [(r.pattern, r.marker or "[X]") for r in S.RULES]),
    "file_languages": _files,
    "pricing_summary": _pricing,
    "nation_revenue": _nation_revenue,
}

_RECURSIVE = """
WITH RECURSIVE o AS (SELECT user_id, id, epoch_us("timestamp") AS us, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp", id) AS k FROM audit_logs WHERE "timestamp" IS NOT NULL AND user_id IS NOT NULL),
r AS (
  SELECT user_id, id, us, k, [us] AS held, true AS admitted, NULL::VARCHAR AS denied_by FROM o WHERE k = 1
  UNION ALL
  SELECT user_id, id, us, k, CASE WHEN denied_by IS NULL THEN list_append(h, us) ELSE h END, denied_by IS NULL, denied_by FROM (
    SELECT *, CASE WHEN len(list_filter(h, lambda t: t > us - 60000000)) >= 2 THEN 'minute' WHEN len(list_filter(h, lambda t: t > us - 3600000000)) >= 10 THEN 'hour' WHEN len(h) >= 40 THEN 'day' END AS denied_by
    FROM (SELECT o.user_id, o.id, o.us, o.k, list_filter(r.held, lambda t: t > o.us - 86400000000) AS h FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)))
SELECT id, admitted, denied_by FROM r"""

ORACLES = {
    "stream_tumbling": """SELECT * FROM (SELECT epoch_us(ts) // 3600000000 * 3600000000 AS slot_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
WHERE slot_us + 3600000000 <= (SELECT max(epoch_ms(ts)) * 1000 - 600000000 FROM events)""",
    "debounce_sessions": """WITH m AS (SELECT *, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 3600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n, max_by(event_type, {'a': us, 'b': event_type}) AS last FROM k GROUP BY user_id, k""",
    "rate_limit_admission": _RECURSIVE,
    "file_languages": """SELECT CASE lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'json' THEN 'json' WHEN 'toml' THEN 'toml' ELSE 'text' END AS language,
  count(*) AS rows, count(DISTINCT repo || chr(0) || regexp_replace(replace(file_path, chr(92), '/'), '^(?:\\./)+', '')) AS files FROM code_chunks GROUP BY 1""",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL",
    "nation_revenue": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
}
