"""Problems 3 and 6 on small cases: nulls, ties, repeats, gaps at the limit, empty tables, clashing columns."""

import random

from conftest import audit_rows

from auditloom.operators import event_features as E
from auditloom.streaming import sessions as S

GAP = S.GAP_US
T0 = 1_514_764_800_000_000


def got(df):
    return sorted(((r.user_id, r.start_us, r.end_us, r.n_calls, r.duration_ms) for r in df.collect()), key=str)


def brute(rows):
    calls = {}
    for r in rows:
        if r.get("timestamp") is None:
            continue
        key = (r.get("user_id"), r["timestamp"], ("r", r["request_id"]) if r.get("request_id") is not None else ("i", r["id"]))
        calls[key] = max(calls.get(key, 0), r.get("duration_ms") or 0)
    out, by = [], {}
    for (u, us, _), d in calls.items():
        by.setdefault(u, []).append((us, d))
    for u, xs in by.items():
        xs.sort()
        cur = None
        for us, d in xs:
            if cur and us - cur[2] <= GAP:
                cur[2], cur[3], cur[4] = us, cur[3] + 1, cur[4] + d
            else:
                cur = [u, us, us, 1, d]
                out.append(cur)
    return sorted(map(tuple, out), key=str)


def test_sessions_limits_nulls_and_repeats(spark):
    rows = [
        {"id": 1, "user_id": "a", "timestamp": T0, "request_id": "x", "duration_ms": 5},
        {"id": 2, "user_id": "a", "timestamp": T0, "request_id": "x", "duration_ms": 5},  # second delivery
        {"id": 3, "user_id": "a", "timestamp": T0 + GAP, "request_id": "y"},  # exactly the gap: same session
        {"id": 4, "user_id": "a", "timestamp": T0 + 2 * GAP + 1, "request_id": "z", "duration_ms": 7},  # one more: next session
        {"id": 5, "user_id": "a", "timestamp": None, "request_id": "n"},
        {"id": 6, "user_id": None, "timestamp": T0 + 5, "request_id": None},
        {"id": 7, "user_id": None, "timestamp": T0 + 5, "request_id": None},  # a tie of two calls
        {"id": 8, "user_id": "b", "timestamp": T0 - 1},
    ]
    result = got(S.sessionize(audit_rows(spark, rows)))
    assert result == brute(rows)
    assert ("a", T0, T0 + GAP, 2, 5) in result and (None, T0 + 5, T0 + 5, 2, 0) in result


def test_sessions_in_several_spans_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [{"id": i, "user_id": rng.choice(["hot", "hot", "u1", "u2", None]), "timestamp": T0 + rng.randrange(0, 20 * 86_400) * 1_000_000, "request_id": f"r{i % 290}", "duration_ms": rng.choice([None, 3])} for i in range(300)]
    df = audit_rows(spark, rows)
    assert got(S.sessionize(df)) == brute(rows)
    assert got(S.sessionize(df, fragments_per_batch=40)) == brute(rows)


def test_sessions_of_nothing(spark):
    assert S.sessionize(audit_rows(spark, [])).count() == 0
    assert S.sessionize(audit_rows(spark, [{"id": 1, "user_id": "a"}])).count() == 0


def tools(spark):
    return spark.createDataFrame([("read_file",), ("write_file",), (None,), ("read_file",)], "tool_name string")


CALLS = [
    {"id": 1, "user_id": "a", "tool_name": "Read-File ", "status": "Success", "timestamp": T0, "duration_ms": 5, "request_id": "x", "anomaly_detected": True},
    {"id": 2, "user_id": "a", "tool_name": "read_file", "status": "success", "timestamp": T0, "duration_ms": 5, "request_id": "x", "anomaly_detected": True},
    {"id": 3, "user_id": "a", "tool_name": "read_file", "status": " ERROR", "timestamp": None, "request_id": "y"},
    {"id": 4, "user_id": "a", "tool_name": None, "status": "success", "timestamp": T0 + 9, "request_id": None},
    {"id": 5, "user_id": None, "tool_name": "unknown", "status": None, "timestamp": T0 + 3, "duration_ms": 2},
]


def test_feature_table(spark):
    df = E.feature_table(audit_rows(spark, CALLS), tools(spark))
    names = E.type_dictionary(tools(spark))
    assert names[0] == "other" and len(df.columns) == 1 + 4 * len(names)
    rows = {r.user_id: r.asDict() for r in df.collect()}
    a, none = rows["a"], rows[None]
    assert a["n__read_file__success"] == 1 and a["ms__read_file__success"] == 5 and a["anomalies__read_file__success"] == 1 and a["last_us__read_file__success"] == T0
    assert a["n__read_file__error"] == 1 and a["last_us__read_file__error"] is None
    assert a["n__other"] == 1 and a["last_us__other"] == T0 + 9 and a["n__write_file__success"] == 0
    assert none["n__other"] == 1 and none["ms__other"] == 2


def test_types_by_broadcast_and_by_shuffle(spark):
    logs = audit_rows(spark, CALLS)
    as_rows = lambda df: sorted(map(str, df.collect()))
    assert as_rows(E.sparse_counts(logs, tools(spark), max_broadcast=1)) == as_rows(E.sparse_counts(logs, tools(spark)))
    index = {r.type: r.idx for r in E.type_index(tools(spark)).collect()}
    assert sorted(index.values()) == list(range(1, len(index) + 1))


def test_vectors_merge(spark):
    logs = audit_rows(spark, CALLS)
    whole = E.sparse_vectors(E.sparse_counts(logs, tools(spark)))
    parts = [E.sparse_vectors(E.sparse_counts(logs.where(c), tools(spark))) for c in ("id <= 2", "id > 2")]
    as_rows = lambda df: sorted((str(r.user_id), list(r.idx), list(r.n), list(r.ms), list(r.anomalies), [x or 0 for x in r.last_us]) for r in df.collect())
    assert as_rows(E.merge(*parts)) == as_rows(whole)


def test_features_of_nothing(spark):
    df = E.feature_table(audit_rows(spark, []), tools(spark))
    assert df.count() == 0 and len(df.columns) == 1 + 4 * 7
