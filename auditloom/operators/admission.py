"""Consent, quotas and usage: semi and anti joins in time, defaults by left join, sliding counts of prior calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators.windows import running
from auditloom.tables import canonical

DAY = 86_400_000_000
HORIZONS = {"in_minute": 60_000_000, "in_hour": 3_600_000_000, "in_day": DAY}


def consents(records: DataFrame) -> DataFrame:
    """Records with times in microseconds and scopes as an array, blanks and repeats removed."""
    parts = F.transform(F.split(F.coalesce("scopes", F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    return records.select("id", "user_id", "client_id", "granted", F.unix_micros("granted_at").alias("granted_us"), F.unix_micros("revoked_at").alias("revoked_us"), F.unix_micros("expires_at").alias("expires_us"), F.array_distinct(F.filter(parts, lambda x: x != "")).alias("scopes"))


def _valid(at):
    return F.col("granted") & (F.col("granted_us") <= at) & (F.col("revoked_us").isNull() | (F.col("revoked_us") > at)) & (F.col("expires_us").isNull() | (F.col("expires_us") > at))


def active(c: DataFrame, as_of: int) -> DataFrame:
    return c.where(_valid(F.lit(as_of)))


def latest(c: DataFrame) -> DataFrame:
    """The newest record of every user and client; an aggregate, so it combines before the shuffle."""
    newest = F.max(F.struct(F.coalesce("granted_us", F.lit(-(1 << 62))).alias("g"), "id")).alias("m")
    return c.groupBy("user_id", "client_id").agg(newest).select("user_id", "client_id", F.col("m.id").alias("id"))


def with_consent(calls: DataFrame, c: DataFrame, how: str) -> DataFrame:
    """Calls that had (semi) or lacked (anti) a valid consent of their user and client at their time."""
    right = c.select(F.col("user_id").alias("cu"), F.col("client_id").alias("cc"), "granted", "granted_us", "revoked_us", "expires_us")
    on = (F.col("user_id") == F.col("cu")) & (F.col("client_id") == F.col("cc")) & _valid(F.col("us"))
    return calls.where("us IS NOT NULL").join(right, on, f"left_{how}")


def quotas(calls: DataFrame, user_quotas: DataFrame) -> DataFrame:
    """Calls per user with the limits that apply; users are folded before they meet their quota."""
    per = calls.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"))
    q = user_quotas.select("user_id", "requests_per_minute", "requests_per_hour", "daily_limit", F.lower(F.trim("tier")).alias("tier"))
    d = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    return per.join(q, "user_id", "left").select("user_id", "calls", d("requests_per_minute", 60).alias("per_minute"), d("requests_per_hour", 1000).alias("per_hour"), d("daily_limit", 10000).alias("per_day"), d("tier", "free").alias("tier"))


def usage(calls: DataFrame) -> DataFrame:
    """id and the number of prior calls of the user within a minute, an hour and a day.

    Every call also asks, for each width, how many calls lie before the window's begin; questions and calls are counted together by
    ``running``, so no window of a day is ever one task's."""
    c = calls.where("us IS NOT NULL").select("user_id", "id", "us")
    marks = [F.struct(F.lit("call").alias("mark"), F.col("us").alias("at")), *[F.struct(F.lit(n).alias("mark"), (F.col("us") - (w - 1)).alias("at")) for n, w in HORIZONS.items()]]
    asked = c.select("user_id", "id", "us", F.explode(F.array(*marks)).alias("m")).select("user_id", "id", "us", "m.mark", "m.at")
    is_call = F.col("mark") == "call"
    counted = running(asked, "user_id", "at", ["at", is_call, "id"], is_call)
    at = lambda m: F.max(F.when(F.col("mark") == m, F.col("pos")))
    return counted.groupBy("user_id", "id", "us").agg(*[(at("call") - at(n)).alias(n) for n in HORIZONS]).select("id", *HORIZONS)


def requests_with_outcome(requests: DataFrame, calls: DataFrame, intents: DataFrame) -> DataFrame:
    """Every request with its first logged call and the category and risk of its tool."""
    first = calls.where("request_id IS NOT NULL").groupBy("request_id").agg(F.min_by("state", "id").alias("state"), F.min("id").alias("call_id"))
    tools = intents.select(F.col("tool_name").alias("t"), "category", "risk_level")
    return requests.select("req_id", "request_id", canonical("tool_name").alias("t")).join(first, "request_id", "left").join(F.broadcast(tools), "t", "left").select("req_id", "call_id", "state", "category", "risk_level")
