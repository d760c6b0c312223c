"""Audit store: filter, page, summarise, export and retain an event log.

All functions take the ``calls`` view (see ``calls``), are null-safe and use an explicit ``as_of``: nothing depends
on the clock. Times are microseconds since 1970 UTC.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.tables import canonical

HOUR = 3_600_000_000
DAY = 24 * HOUR


def calls(audit_logs: DataFrame) -> DataFrame:
    """Audit rows with canonical tool and status and the time as ``us``; other columns as stored."""
    return audit_logs.withColumns({"tool": canonical("tool_name"), "state": canonical("status"), "us": F.unix_micros("timestamp")}).drop("tool_name", "status", "timestamp")


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Conjunction of the conditions that are given: equality by column name, ``since``/``until`` (inclusive),
    ``min_anomaly_score``, and flags, for which False is a condition and None is not."""
    tests: list[Column] = []
    for name, value in wanted.items():
        if value is None or value == "":
            continue
        if name == "since":
            tests.append(F.col("us") >= value)
        elif name == "until":
            tests.append(F.col("us") <= value)
        elif name == "min_anomaly_score":
            tests.append(F.col("anomaly_score") >= value)
        elif name == "ip":
            tests.append(F.col("ip_address") == F.substring(F.sha2(F.lit(value), 256), 1, 16))
        else:
            tests.append(F.col(name) == value)
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def recent(df: DataFrame, as_of: int, hours: int) -> DataFrame:
    return df.where(F.col("us") > as_of - hours * HOUR)


def page(df: DataFrame, number: int, size: int, most: int = 100) -> DataFrame:
    """Newest first; pages are at most ``most`` rows."""
    size = min(size, most)
    return df.orderBy(F.col("us").desc_nulls_last(), F.col("id").desc()).offset((number - 1) * size).limit(size)


def visible_to(df: DataFrame, user: str, is_admin: bool) -> DataFrame:
    """Row-level rule: others than administrators see their own rows."""
    return df if is_admin else df.where(F.col("user_id") == user)


def top_per_group(counts: DataFrame, group: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of every group with their rank."""
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def activity_summary(df: DataFrame) -> DataFrame:
    """One row per user in one pass: counts by status, distinct tools and addresses, durations, anomalies, span.

    Distinct counts go through (user, tool) and (user, address) pre-aggregates, so a user with a third of all rows
    is folded before anything is shuffled."""
    main = df.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "success").alias("n_success"), F.count_if(F.col("state") == "denied").alias("n_denied"), F.count_if(F.col("state") == "error").alias("n_error"),
        F.count_if(F.coalesce("anomaly_detected", F.lit(False))).alias("n_anomalies"), F.nullif(F.round(F.avg("duration_ms"), 2), F.lit(0.0)).alias("avg_duration_ms"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
    )
    tools = df.groupBy("user_id", "tool").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.count("tool").alias("n_tools"), F.max_by("tool", F.struct("n", F.col("tool"))).alias("top_tool"))
    ips = df.groupBy("user_id", "ip_address").agg(F.lit(1)).groupBy("user_id").agg(F.count("ip_address").alias("n_ips"))
    return main.join(tools, "user_id").join(ips, "user_id")


def retention_split(df: DataFrame, as_of: int, days: int) -> tuple[DataFrame, DataFrame]:
    """(kept, expired): rows older than the retention go to the archive; rows without time are kept."""
    old = F.coalesce(F.col("us") < as_of - days * DAY, F.lit(False))
    return df.where(~old), df.where(old)


def retention_stats(df: DataFrame, as_of: int, days: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("us") < as_of - days * DAY).alias("expiring"), F.min("us").alias("oldest_us"), F.max("us").alias("newest_us"))


EXPORT = ("id", "user_id", "client_id", "tool", "state", "us", "duration_ms", "request_id", "session_id", "anomaly_score")


def as_json(df: DataFrame, columns=EXPORT) -> DataFrame:
    """One JSON object per row; null fields are left out."""
    return df.select("id", F.to_json(F.struct(*columns)).alias("line"))


def as_csv(df: DataFrame, columns=EXPORT) -> DataFrame:
    """One CSV line per row; null and zero become blank fields."""
    blank = lambda c: F.when(F.col(c).isNull() | (F.col(c).cast("string").isin("0", "0.0", "")), "").otherwise(F.col(c).cast("string"))
    return df.select("id", F.concat_ws(",", *[blank(c) for c in columns]).alias("line"))
