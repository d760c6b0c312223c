"""Event-time windows over streams: tumbling counts with a watermark, and debounced changes by session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.session import staging_path


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run a streaming DataFrame over what its source has now, and read the result; output and state are in the shared folder."""
    spark: SparkSession = stream.sparkSession
    out, ckpt = staging_path(spark, name), staging_path(spark, f"{name}-state")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(out)


def tumbling(stream: DataFrame, width: str, late: str, *by: str) -> DataFrame:
    """Final counts of windows that the watermark has passed."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.unix_micros("window.start").alias("slot_us"), *by, "n", F.round("total", 4).alias("total"))


def debounced(df: DataFrame, key: str, gap: str, payload: str) -> DataFrame:
    """One row per burst of changes of a key: start, end, number and last payload. Works on batches and on streams
    (with a watermark), since session windows merge partial sessions map-side."""
    w = df.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("ts", payload)).alias("last"))
    return w.select(key, F.unix_micros("w.start").alias("start_us"), F.unix_micros("last.ts").alias("end_us"), "n", F.col(f"last.{payload}").alias("last"))
