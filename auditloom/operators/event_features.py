"""Problem 3: one row per entity with counts, recency and totals for every type of event.

Types (tool x status) are encoded as indices by a dictionary, which is a table. Events fold to one row per entity
and index (map-side combine, so an entity or type with a third of all rows never gathers in one task), those to
one row per entity with sparse vectors of index, count, total duration, anomalies and latest time. Sparse
vectors are mergeable: ``merge`` adds counts and totals and keeps the later time, so daily vectors can be
maintained instead of re-reading all events. Only at the end they are expanded into columns, batch by batch.

A second delivery of a call (equal in all but id) counts once.
Defined cases: spelling variants of tool and status are unified; a null or unknown tool or status is the type
``other``; a null user_id is an entity of its own; null durations and flags add nothing; null timestamps count,
but have no recency; an empty table gives no rows and the same columns; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.tables import canonical

STATUSES = ("success", "denied", "error")
MAX_TYPES = 20_000
MEASURES = ("n", "ms", "anomalies", "last_us")


def type_names(tools: DataFrame) -> DataFrame:
    """type: one row per tool x status, a table of any length."""
    names = tools.select(canonical("tool_name").alias("t")).where("t IS NOT NULL AND t <> ''").distinct()
    return names.select(F.explode(F.array(*[F.concat("t", F.lit(f"__{s}")) for s in STATUSES])).alias("type"))


def type_index(tools: DataFrame) -> DataFrame:
    """type and idx in order of the names; ``other`` is 0. Numbered inside hash buckets on top of the buckets' counts, so it is not one task's work."""
    keyed = type_names(tools).withColumn("bucket", F.pmod(F.xxhash64("type"), F.lit(64)))
    base = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = keyed.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("type")))
    return inner.join(F.broadcast(base), "bucket").select("type", (F.col("base") + F.col("r")).cast("int").alias("idx"))


def type_dictionary(tools: DataFrame) -> list[str]:
    """Names of the types in order of their indices, for the expansion into columns; a table cannot have more than ``MAX_TYPES`` x 4
    of them. Beyond that the sparse vectors are the result: they have no such bound."""
    rows = type_index(tools).orderBy("idx").limit(MAX_TYPES + 1).collect()
    if len(rows) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} types: columns cannot hold them, use sparse_vectors")
    return ["other", *[r.type for r in rows]]


def calls_once(events: DataFrame) -> DataFrame:
    """user_id, type name, us, ms, anomaly of every call; a second delivery has the same request_id and folds away."""
    status = canonical("status")
    kind = F.when(status.isin(*STATUSES) & F.col("tool_name").isNotNull(), F.concat(canonical("tool_name"), F.lit("__"), status)).otherwise(F.lit("other"))
    call = F.coalesce(F.concat(F.lit("r"), "request_id"), F.concat(F.lit("i"), F.col("id").cast("string")))
    rows = events.select(
        "user_id", kind.alias("type"), F.unix_micros("timestamp").alias("us"), call.alias("call"),
        F.coalesce("duration_ms", F.lit(0)).cast("bigint").alias("ms"), F.coalesce("anomaly_detected", F.lit(False)).cast("bigint").alias("anomaly"),
    )
    return rows.groupBy("user_id", "call", "us", "type").agg(F.max("ms").alias("ms"), F.max("anomaly").alias("anomaly"))


def sparse_counts(events: DataFrame, tools: DataFrame, max_broadcast: int = MAX_TYPES) -> DataFrame:
    """user_id, idx, type, n, ms, anomalies, last_us; one row per entity and type that occurs. The index is broadcast behind a check of its
    length and shuffled beyond it."""
    index = type_index(tools)
    if index.limit(max_broadcast + 1).count() <= max_broadcast:
        index = F.broadcast(index)
    typed = calls_once(events).join(index, "type", "left").withColumns({"type": F.when(F.col("idx").isNull(), "other").otherwise(F.col("type")), "idx": F.coalesce("idx", F.lit(0))})
    return typed.groupBy("user_id", "idx", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("ms"), F.sum("anomaly").alias("anomalies"), F.max("us").alias("last_us"))


def sparse_vectors(counts: DataFrame) -> DataFrame:
    """One row per entity: aligned arrays idx, n, ms, anomalies, last_us, in order of idx."""
    v = F.array_sort(F.collect_list(F.struct("idx", *MEASURES)))
    return counts.groupBy("user_id").agg(v.alias("v")).select("user_id", *[F.col(f"v.{c}").alias(c) for c in ("idx", *MEASURES)])


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sparse vectors of two disjoint sets of calls, merged: counts and totals add, the later time stays."""
    long = a.unionByName(b).select("user_id", F.explode(F.arrays_zip("idx", *MEASURES)).alias("x")).select("user_id", "x.*")
    return sparse_vectors(long.groupBy("user_id", "idx").agg(F.sum("n").alias("n"), F.sum("ms").alias("ms"), F.sum("anomalies").alias("anomalies"), F.max("last_us").alias("last_us")))


def expand(vectors: DataFrame, names: list[str]) -> DataFrame:
    """Columns n__<type>, ms__<type>, anomalies__<type> (0 where absent) and last_us__<type> (null where absent)."""
    cols = [f"{m}__{t}" for m in MEASURES for t in names]
    schema = T.StructType([T.StructField("user_id", T.StringType()), *[T.StructField(c, T.LongType()) for c in cols]])
    k = len(names)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):  # dense rows are wide: few at a time
                b = whole.slice(at, 512)
                idx = b.column("idx")
                rows = np.repeat(np.arange(b.num_rows), np.diff(idx.offsets.to_numpy()))
                where = idx.flatten().to_numpy()
                arrays = [b.column("user_id")]
                for m in MEASURES:
                    dense = np.zeros((k, b.num_rows), dtype=np.int64)
                    values = b.column(m).flatten().to_numpy(zero_copy_only=False)
                    if m == "last_us":
                        absent = np.ones((k, b.num_rows), dtype=bool)
                        there = ~np.isnan(values.astype(float))
                        absent[where[there], rows[there]] = False
                        dense[where[there], rows[there]] = values[there].astype(np.int64)
                        arrays += [pa.array(dense[i], mask=absent[i]) for i in range(k)]
                    else:
                        dense[where, rows] = values
                        arrays += [pa.array(dense[i]) for i in range(k)]
                yield pa.RecordBatch.from_arrays(arrays, names=["user_id", *cols])

    return vectors.mapInArrow(scatter, schema)


def feature_table(events: DataFrame, tools: DataFrame) -> DataFrame:
    return expand(sparse_vectors(sparse_counts(events, tools)), type_dictionary(tools))
