"""Every core query against its SQL on the smallest tables; those without SQL against what is known of their rows."""

import pytest
from conftest import SMALL, same

from auditloom.plans.registry import ORACLES, QUERIES


def _forest(spark, duck):
    rows = QUERIES["iforest"](spark, SMALL).collect()
    ids = {i for (i,) in duck.execute('SELECT id FROM audit_logs WHERE "timestamp" IS NOT NULL').fetchall()}
    assert {r.id for r in rows} == ids and len(rows) == len(ids) and all(0 < r.score < 1 for r in rows)
    assert sorted(rows) == sorted(QUERIES["iforest"](spark, SMALL).collect()) and len({r.score for r in rows}) > 10


def _features(spark, duck):
    wide = QUERIES["p3_features"](spark, SMALL).collect()
    want = {}
    for r in QUERIES["p3_sparse"](spark, SMALL).collect():
        want[r.user_id, r.type] = (r.n, r.ms, r.anomalies, r.last_us)
    names = [c[3:] for c in wide[0].asDict() if c.startswith("n__")]
    got = {(r.user_id, t): tuple(r[f"{m}__{t}"] for m in ("n", "ms", "anomalies", "last_us")) for r in wide for t in names if r[f"n__{t}"]}
    assert got == want and len(wide) == len({u for u, _ in want})


def _json(spark, duck):
    given = dict(duck.execute("SELECT id, tool_input FROM audit_logs").fetchall())
    rows = QUERIES["sanitize_json"](spark, SMALL).collect()
    assert {r.id for r in rows} == set(given) and all((r.text is None) == (given[r.id] is None) for r in rows)
    assert not any("@" in r.text and ".example" in r.text.split("@", 1)[1][:20] for r in rows if r.text and r.text.startswith("{") and "[X]" not in r.text and "REDACTED" not in r.text)


def _definitions(spark, duck):
    content = {i: t.split("\n") for i, t in duck.execute("SELECT chunk_id, content FROM code_chunks WHERE lower(file_path) LIKE '%.py' AND content IS NOT NULL").fetchall()}
    rows = QUERIES["extract_defs"](spark, SMALL).collect()
    assert len(rows) > 50
    for r in rows:
        near = "\n".join(content[r.chunk_id][r.line - 1 : r.end_line])
        assert (r.name.split(".")[-1] if r.kind == "import" else r.name) in near


KNOWN = {"iforest": _forest, "p3_features": _features, "sanitize_json": _json, "extract_defs": _definitions}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name in ORACLES:
        same(QUERIES[name](spark, SMALL), duck, ORACLES[name])
    else:
        KNOWN[name](spark, duck)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
