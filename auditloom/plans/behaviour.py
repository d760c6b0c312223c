"""Queries of behaviour analytics, consent and usage, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import admission as AD
from auditloom.operators import behaviour as B
from auditloom.operators import outliers as O
from auditloom.plans.audit import AS_OF, CALLS, c
from auditloom.tables import table

AFTER = 1514764800000000 + 10 * 86_400_000_000  # consents are judged at this time


def feats(s, d, **kw):
    return B.features(c(s, d), **kw)


def one(name, **kw):
    return lambda s, d: feats(s, d, with_entropy=name == "sequence_entropy", **kw).select("id", name)


def consents(s, d):
    return AD.consents(table(s, d, "consent_records"))


def _three(s, d):
    f = c(s, d).where("us IS NOT NULL")
    return f.select("id", F.coalesce("duration_ms", F.lit(0)).cast("double").alias("duration"), F.coalesce("anomaly_score", F.lit(0.0)).alias("anomaly"), F.coalesce(F.char_length("tool_input"), F.lit(0)).cast("double").alias("length"))


def _wide(s, d):
    return B.minmax(_three(s, d), ["duration", "anomaly", "length"])


def _iforest(s, d):
    return O.isolation_scores(feats(s, d), list(B.FEATURES))


QUERIES = {
    **{f"feat_{n}": one(n) for n in B.FEATURES},
    "behavior_features": lambda s, d: feats(s, d),
    "transition_matrix": lambda s, d: B.transitions(c(s, d)),
    "anomaly_rules": lambda s, d: B.rule_score(feats(s, d)),
    "explain_top5": lambda s, d: B.explanations(feats(s, d)),
    "importance_summary": lambda s, d: B.explanations(feats(s, d)).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("importance"), 4).alias("importance")),
    "feature_scaler": lambda s, d: B.scaled(_three(s, d), ["duration", "anomaly", "length"]),
    "minmax_scores": _wide,
    "ensemble_score": lambda s, d: B.ensemble(_wide(s, d), {"duration": 0.4, "anomaly": 0.35, "length": 0.25}),
    "iforest": _iforest,
    "active_consents": lambda s, d: AD.active(consents(s, d), AFTER).select("id"),
    "consent_list": lambda s, d: AD.latest(consents(s, d)).select("user_id", "client_id", "id"),
    "consent_semi": lambda s, d: AD.with_consent(c(s, d), consents(s, d), "semi").select("id"),
    "consent_anti": lambda s, d: AD.with_consent(c(s, d), consents(s, d), "anti").select("id"),
    "consent_scopes": lambda s, d: consents(s, d).select("id", F.explode("scopes").alias("scope")).groupBy("scope").agg(F.count(F.lit(1)).alias("n")),
    "ttl_live": lambda s, d: consents(s, d).where(F.col("expires_us") > AS_OF).select("id"),
    "quota_effective": lambda s, d: AD.quotas(c(s, d), table(s, d, "user_quotas")),
    "usage_windows": lambda s, d: AD.usage(c(s, d)),
    "tool_requests_enriched": lambda s, d: AD.requests_with_outcome(table(s, d, "tool_requests"), c(s, d), table(s, d, "tool_intents")),
}

_F = f"""WITH {CALLS},
b AS (SELECT *, CASE WHEN json_valid(tool_input) THEN json_extract_string(tool_input, '$.path') END AS path, coalesce(length(tool_input), 0) AS size FROM calls WHERE us IS NOT NULL),
o AS (SELECT *, lag(us) OVER w AS prev_us, lag(tool) OVER w AS prev_tool, row_number() OVER w - 1 AS pos, min(us) OVER (PARTITION BY user_id) AS first_us,
  list(tool) OVER (PARTITION BY user_id ORDER BY us, id ROWS BETWEEN 100 PRECEDING AND CURRENT ROW) AS tools,
  CASE WHEN ip_address IS NULL THEN 0 ELSE (row_number() OVER (PARTITION BY user_id, ip_address ORDER BY us, id) = 1)::INT END::DOUBLE AS new_ip,
  avg(size) OVER (PARTITION BY tool) AS mean, stddev_pop(size) OVER (PARTITION BY tool) AS std, count(*) OVER (PARTITION BY tool) AS k
  FROM b WINDOW w AS (PARTITION BY user_id ORDER BY us, id)),
r AS (SELECT *, least(pos - min(pos) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW), 60)::DOUBLE AS request_rate FROM o),
m AS (SELECT prev_tool AS src, tool AS dst, count(*) AS n FROM o WHERE prev_tool IS NOT NULL GROUP BY ALL), p AS (SELECT src, dst, n, round(n / sum(n) OVER (PARTITION BY src), 6) AS p FROM m),
f AS (SELECT id, user_id, CASE WHEN prev_us IS NULL THEN 3600 ELSE least(greatest((us - prev_us) / 1e6, 0), 7200) END::DOUBLE AS time_since_last,
  (us // 3600000000 % 24 < 6 OR us // 3600000000 % 24 > 22 OR (us // 86400000000 + 3) % 7 >= 5)::INT::DOUBLE AS unusual_hour, least((us - first_us) / 1e6, 14400)::DOUBLE AS session_duration, request_rate,
  CASE WHEN lag(request_rate, 2) OVER w IS NULL THEN 0 ELSE greatest(least((request_rate - lag(request_rate) OVER w) - (lag(request_rate) OVER w - lag(request_rate, 2) OVER w), 10), -10) END::DOUBLE AS velocity_change,
  coalesce((tool <> prev_tool)::INT, 0)::DOUBLE AS tool_changed,
  CASE WHEN len(tools) < 6 THEN 0.5 WHEN len(list_distinct(tools)) <= 1 THEN 0 ELSE round(list_sum(list_transform(map_values(list_histogram(tools)), lambda x: -(x / len(tools)) * log2(x / len(tools)))) / log2(len(list_distinct(tools))), 6) END::DOUBLE AS sequence_entropy,
  CASE WHEN prev_tool IS NULL THEN 0.5 ELSE coalesce(p, 0.1) END::DOUBLE AS transition_prob,
  CASE WHEN path IS NULL OR path = '' THEN 0 {' '.join(f"WHEN regexp_matches(path, '{p}') THEN {v}" for v, p in B.SENSITIVE)} ELSE 0.1 END::DOUBLE AS file_sensitivity,
  least(len(list_filter(string_split(replace(coalesce(path, ''), chr(92), '/'), '/'), lambda x: x <> '')) / 10.0, 1.0)::DOUBLE AS resource_depth, new_ip,
  round(CASE WHEN k < 10 OR std = 0 THEN 0 ELSE greatest(least((size - mean) / std, 3), -3) END, 6)::DOUBLE AS size_z
  FROM r LEFT JOIN p ON p.src = r.prev_tool AND p.dst = r.tool WINDOW w AS (PARTITION BY user_id ORDER BY us, id))"""
_SCORE = "round(" + " + ".join(f"CASE WHEN {cond} THEN {w} ELSE 0 END::DOUBLE" for _, cond, w, _ in B.RULES) + ", 6)"
_HITS = " UNION ALL ".join(f"SELECT id, '{n}' AS feature, {w}::DOUBLE AS importance FROM f WHERE {cond}" for n, cond, w, _ in B.RULES)
_TOP = f", h AS ({_HITS}), t AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY importance DESC, feature) AS rank, feature, importance FROM h), top AS (SELECT * FROM t WHERE rank <= 5)"
_THREE = f"WITH {CALLS}, x AS (SELECT id, coalesce(duration_ms, 0)::DOUBLE AS duration, coalesce(anomaly_score, 0) AS anomaly, coalesce(length(tool_input), 0)::DOUBLE AS length FROM calls WHERE us IS NOT NULL)"
_MM = _THREE + ", mm AS (SELECT id, " + ", ".join(f"round(({k} - min({k}) OVER ()) / (max({k}) OVER () - min({k}) OVER () + 1e-10), 6) AS {k}" for k in ("duration", "anomaly", "length")) + " FROM x)"
_CONS = """c AS (SELECT id, user_id, client_id, granted, epoch_us(granted_at) AS granted_us, epoch_us(revoked_at) AS revoked_us, epoch_us(expires_at) AS expires_us,
  list_distinct(list_filter(list_transform(string_split(coalesce(scopes, ''), ','), lambda x: lower(trim(x))), lambda x: x <> '')) AS scopes FROM consent_records)"""
_HAS = "FROM calls WHERE us IS NOT NULL AND {0} EXISTS (SELECT 1 FROM c WHERE c.user_id = calls.user_id AND c.client_id = calls.client_id AND granted AND granted_us <= us AND (revoked_us IS NULL OR revoked_us > us) AND (expires_us IS NULL OR expires_us > us))"

ORACLES = {
    **{f"feat_{n}": _F + f" SELECT id, {n} FROM f" for n in B.FEATURES},
    "behavior_features": _F + " SELECT * FROM f",
    "transition_matrix": _F + " SELECT src, dst, n, p FROM p",
    "anomaly_rules": _F + f" SELECT id, least({_SCORE}, 1) AS score, {_SCORE} >= 0.5 AS flagged, concat_ws('; ', " + ", ".join(f"CASE WHEN {cond} THEN '{r}' END" for _, cond, _, r in B.RULES) + ") AS reasons FROM f",
    "explain_top5": _F + _TOP + " SELECT * FROM top",
    "importance_summary": _F + _TOP + " SELECT feature, count(*) AS n, round(sum(importance), 4) AS importance FROM top GROUP BY 1",
    "feature_scaler": _THREE + " SELECT id, " + ", ".join(f"round(CASE WHEN stddev_pop({k}) OVER () = 0 THEN 0 ELSE ({k} - avg({k}) OVER ()) / stddev_pop({k}) OVER () END, 5) AS {k}" for k in ("duration", "anomaly", "length")) + " FROM x",
    "minmax_scores": _MM + " SELECT * FROM mm",
    "ensemble_score": _MM + " SELECT id, round((duration * 0.4::DOUBLE + anomaly * 0.35::DOUBLE + length * 0.25::DOUBLE) / (0.4::DOUBLE + 0.35::DOUBLE + 0.25::DOUBLE), 8) AS score FROM mm",
    "active_consents": f"WITH {_CONS} SELECT id FROM c WHERE granted AND granted_us <= {AFTER} AND (revoked_us IS NULL OR revoked_us > {AFTER}) AND (expires_us IS NULL OR expires_us > {AFTER})",
    "consent_list": f"WITH {_CONS} SELECT user_id, client_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, client_id ORDER BY granted_us DESC NULLS LAST, id DESC) AS r FROM c) WHERE r = 1",
    "consent_semi": f"WITH {CALLS}, {_CONS} SELECT id {_HAS.format('')}",
    "consent_anti": f"WITH {CALLS}, {_CONS} SELECT id {_HAS.format('NOT')}",
    "consent_scopes": f"WITH {_CONS} SELECT s AS scope, count(*) AS n FROM c, unnest(scopes) AS t(s) GROUP BY 1",
    "ttl_live": f"WITH {_CONS} SELECT id FROM c WHERE expires_us > {AS_OF}",
    "quota_effective": f"""WITH {CALLS}, u AS (SELECT user_id, count(*) AS calls FROM calls GROUP BY 1)
SELECT u.user_id, calls, coalesce(requests_per_minute, 60) AS per_minute, coalesce(requests_per_hour, 1000) AS per_hour, coalesce(daily_limit, 10000) AS per_day, coalesce(lower(trim(tier)), 'free') AS tier FROM u LEFT JOIN user_quotas q ON q.user_id = u.user_id""",
    "usage_windows": f"""WITH {CALLS}, o AS (SELECT id, user_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us, id) - 1 AS pos FROM calls WHERE us IS NOT NULL)
SELECT id, {', '.join(f"pos - min(pos) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS {n}" for n, w in (('in_minute', 60000000), ('in_hour', 3600000000), ('in_day', 86400000000)))} FROM o""",
    "tool_requests_enriched": f"""WITH {CALLS}, first AS (SELECT request_id, min_by(state, id) AS state, min(id) AS call_id FROM calls WHERE request_id IS NOT NULL GROUP BY 1)
SELECT req_id, call_id, state, category, risk_level FROM tool_requests r LEFT JOIN first USING (request_id) LEFT JOIN tool_intents t ON t.tool_name = regexp_replace(lower(trim(r.tool_name)), '[\\s\\-.]+', '_', 'g')""",
}
