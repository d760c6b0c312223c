"""Session defaults and the shared folder that cut lineage and staged tables are written to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("auditloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session may do without: it gets a temporary folder of its own; on a
    cluster such a folder is not shared, so there an unset option is an error."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    root = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None) or (current.get() if current.isDefined() else None)
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError(f"{CHECKPOINT_CONF} is not set: name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not current.isDefined():
        sc.setCheckpointDir(root)
    return root


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder, which is deleted when the application ends."""
    own = f"{checkpoint_root(spark).rstrip('/')}/auditloom-{spark.sparkContext.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(own)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def bounded_broadcast(df: DataFrame, max_rows: int) -> tuple[bool, DataFrame]:
    """(True, df) when ``df`` has at most ``max_rows`` rows, found by reading no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows, df
