import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import glob

    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


def same(df, con, sql):
    """Rows of a DataFrame equal those of a SQL text, in any order."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    at = [names.index(n) for n in order]
    got = sorted(tuple(plain(r[n]) for n in order) for r in df.collect())
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rows)


AUDIT = (
    "id bigint, user_id string, client_id string, tool_name string, tool_input string, tool_output_hash string, tool_output_sanitized string, status string, deny_reason string, timestamp timestamp, duration_ms int, "
    "ip_address string, user_agent string, request_id string, session_id string, intent_check_passed boolean, intent_confidence double, anomaly_score double, anomaly_detected boolean"
)
#: Columns that no table has, named as operators name things inside.
CLASH = ("us", "slot", "call", "type", "idx", "n", "d", "x", "h", "p", "kind", "features", "rows", "language", "hits", "w", "block", "pos", "own", "t", "v", "s", "bucket", "text_kind", "start", "end", "spans", "first", "tokens", "owners", "surface")


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("?") for c in CLASH if c not in df.columns})


def audit_rows(spark, rows):
    """Rows given as dicts; what is missing is null."""
    import datetime

    names = [c.strip().split()[0] for c in AUDIT.split(", ")]

    def value(r, n):
        v = r.get(n)
        return datetime.datetime.fromtimestamp(v / 1e6, datetime.timezone.utc) if n == "timestamp" and isinstance(v, (int, float)) else v

    return clashing(spark.createDataFrame([tuple(value(r, n) for n in names) for r in rows], AUDIT))
