"""Queries over event time series: rates, increases, quantiles of bucketed histograms, and alert conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def slot(width_us: int, us: str = "us"):
    return (F.floor(F.col(us) / F.lit(width_us)) * F.lit(width_us)).cast("bigint")


def rate(df: DataFrame, width_us: int, *by: str) -> DataFrame:
    """Events and events per second in each slot of time and label."""
    n = F.count(F.lit(1))
    return df.where("us IS NOT NULL").groupBy(slot(width_us).alias("slot_us"), *by).agg(n.alias("n"), F.round(n / F.lit(width_us / 1e6), 6).alias("per_second"))


def sliding(df: DataFrame, width_us: int, step_us: int, *by: str) -> DataFrame:
    """Counts of windows of ``width_us`` that begin every ``step_us``: counted per step first, so every event is
    copied to no more than width / step partial sums instead of rows."""
    steps = df.where("us IS NOT NULL").groupBy(slot(step_us).alias("s"), *by).agg(F.count(F.lit(1)).alias("c"))
    k = width_us // step_us
    starts = F.sequence(F.col("s") - F.lit((k - 1) * step_us), F.col("s"), F.lit(step_us))
    return steps.select(*by, "c", F.explode(starts).alias("slot_us")).groupBy("slot_us", *by).agg(F.sum("c").alias("n"))


def cumulative_buckets(df: DataFrame, value: str, bounds: list[float], *by: str) -> DataFrame:
    """Rows (label, le, n): events with a value up to each bound, +Inf (as 1e308) last."""
    sums = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)] + [F.count(value).alias(f"b{len(bounds)}")]
    wide = df.where(F.col(value).isNotNull()).groupBy(*by).agg(*sums)
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate([*bounds, 1e308])])
    return wide.select(*by, F.explode(pairs).alias("p")).select(*by, "p.le", "p.n")


def histogram_quantile(buckets: DataFrame, q: float, *by: str) -> DataFrame:
    """Linear interpolation inside the bucket that holds the rank; the lowest bound is 0, +Inf gives the top finite bound."""
    w = Window.partitionBy(*by).orderBy("le")
    total = F.max("n").over(Window.partitionBy(*by))
    x = buckets.withColumns({"lo": F.lag("le", 1, 0.0).over(w), "below": F.lag("n", 1, 0).over(w), "total": total}).withColumn("target", F.col("total") * F.lit(q))
    hit = x.where((F.col("n") >= F.col("target")) & (F.col("total") > 0)).withColumn("first", F.row_number().over(w)).where("first = 1")
    inside = F.col("lo") + (F.col("le") - F.col("lo")) * F.try_divide(F.col("target") - F.col("below"), F.col("n") - F.col("below"))
    value = F.when(F.col("le") >= 1e308, F.col("lo")).otherwise(F.coalesce(inside, F.col("le")))
    return hit.select(*by, F.round(value, 4).alias("value"))


def dense_hours(counts: DataFrame, *by: str) -> DataFrame:
    """Every label with every hour between the first and the last of the table; hours without events count 0."""
    span = counts.agg(F.min("slot_us").alias("lo"), F.max("slot_us").alias("hi")).where("lo IS NOT NULL")
    grid = counts.select(*by).distinct().crossJoin(F.broadcast(span)).select(*by, F.explode(F.sequence("lo", "hi", F.lit(HOUR))).alias("slot_us"))
    return grid.join(counts, [*by, "slot_us"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def spikes(hourly: DataFrame, factor: float, *by: str) -> DataFrame:
    """Hours whose count exceeds ``factor`` times the hour before (offset 1h)."""
    w = Window.partitionBy(*by).orderBy("slot_us")
    x = hourly.withColumns({"before": F.lag("n").over(w), "at": F.lag("slot_us").over(w)})
    return x.where((F.col("slot_us") - F.col("at") == HOUR) & (F.col("n") > F.col("before") * F.lit(factor))).select(*by, "slot_us", "n", "before")


def drift(hourly: DataFrame, width: int, factor: float, *by: str) -> DataFrame:
    """Hours above ``factor`` times the mean of the ``width`` hours before, on a dense grid."""
    w = Window.partitionBy(*by).orderBy("slot_us").rowsBetween(-width, -1)
    x = hourly.withColumns({"mean": F.avg("n").over(w), "k": F.count("n").over(w)})
    return x.where((F.col("k") == width) & (F.col("n") > F.col("mean") * F.lit(factor)) & (F.col("n") > 0)).select(*by, "slot_us", "n", F.round("mean", 6).alias("mean"))


def lasting(flags: DataFrame, width_us: int, at_least: int, *by: str) -> DataFrame:
    """Runs of consecutive slots in which a condition holds, of at least ``at_least`` slots (threshold with ``for``)."""
    w = Window.partitionBy(*by).orderBy("slot_us")
    x = flags.where("firing").withColumn("k", F.col("slot_us") - F.row_number().over(w) * F.lit(width_us))
    return x.groupBy(*by, "k").agg(F.min("slot_us").alias("from_us"), F.max("slot_us").alias("to_us"), F.count(F.lit(1)).alias("slots")).where(F.col("slots") >= at_least).drop("k")


def against_global(df: DataFrame, value: str, factor: float, *by: str) -> DataFrame:
    """Labels whose mean exceeds ``factor`` times the mean of all; sums are folded once, the global one is a row."""
    parts = df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    whole = df.agg(F.avg(value).alias("g"))
    mean = F.try_divide("s", "n")
    return parts.crossJoin(F.broadcast(whole)).where(mean > F.col("g") * factor).select(*by, "n", F.round(mean, 6).alias("mean"), F.round("g", 6).alias("global_mean"))
