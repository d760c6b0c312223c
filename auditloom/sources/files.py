"""Sources and sinks: recursive text scans, directory listings, JSON lines, CSV and partitioned Parquet archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXCLUDED = ("node_modules", ".git", "__pycache__", "venv", "dist", "build")

# Languages by file extension.
EXTENSIONS = {
    "py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript", "tsx": "typescript", "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "md": "markdown", "txt": "text", "sh": "shell",
    "java": "java", "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "sql": "sql", "html": "html", "css": "css", "xml": "xml",
}


def language(path):
    """Language of a path by its extension, any letter case; unknown ones are text."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    pairs = [x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), ext), F.lit("text"))


def normal_path(path):
    """Separators as ``/``, leading ``./`` removed."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")


def _wanted(df: DataFrame, excluded=EXCLUDED) -> DataFrame:
    bad = "|".join(e.replace(".", r"\.") for e in excluded)
    return df.where(~F.rlike("path", F.lit(rf"(?:^|/)(?:{bad})(?:/|$)")))


def scan_texts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path and content of every text file under a folder; whole segments of the excluded names are left out."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    return _wanted(df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, size and time of every file; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return _wanted(df.select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified_us")))


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def archive(df: DataFrame, path: str, us: str = "us") -> None:
    """Append to an archive partitioned by day, so that retention drops folders instead of rows."""
    df.withColumn("day", F.to_date(F.timestamp_micros(us))).write.mode("append").partitionBy("day").parquet(path)
