"""Per-entity sequences that survive hot entities.

A window partitioned by entity puts all rows of an entity into one task. ``in_blocks`` numbers the rows of every
entity (counts per entity and minute first, row numbers only inside a minute) and cuts the numbering into blocks;
each block also gets the ``halo`` rows before it, so row frames and lags up to that reach are exact while an
entity with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOT = 60_000_000
BLOCK = 100_000
HALO = 104


def running(df: DataFrame, key: str, us: str, order: list, counted=None) -> DataFrame:
    """Adds ``pos``: how many counted rows (all by default) of the key come before, in order of ``order``, whose first column is the time."""
    one = F.lit(1) if counted is None else counted.cast("int")
    x = df.withColumns({"_slot": F.floor(F.col(us) / SLOT).cast("bigint"), "_one": one})
    per = x.groupBy(key, "_slot").agg(F.sum("_one").alias("_n"))
    base = per.select(F.col(key).alias("_key"), F.col("_slot").alias("_s"), F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    before = F.coalesce(F.sum("_one").over(Window.partitionBy(key, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = x.withColumn("_r", before).join(base, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slot") == F.col("_s")))
    return joined.withColumn("pos", F.col("_base") + F.col("_r")).drop("_slot", "_s", "_key", "_r", "_base", "_one")


def numbered(df: DataFrame, key: str, us: str, tie: str) -> DataFrame:
    """Adds ``pos``: 0, 1, 2... per key in order of (us, tie)."""
    return running(df, key, us, [us, tie])


def in_blocks(df: DataFrame, key: str, us: str, tie: str, block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """Rows with ``pos``, ``block`` and ``own``: rows of the halo have own = false and are dropped after the windows."""
    x = numbered(df, key, us, tie).withColumn("_b", F.floor(F.col("pos") / block).cast("bigint"))
    blocks = F.when(F.col("pos") % block >= block - halo, F.array("_b", F.col("_b") + 1)).otherwise(F.array("_b"))
    return x.withColumn("block", F.explode(blocks)).withColumn("own", F.col("block") == F.col("_b")).drop("_b")


def sequence(key: str):
    return Window.partitionBy(key, "block").orderBy("pos")
