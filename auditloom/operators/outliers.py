"""Isolation forest: trees grown on bounded random samples, every row scored in Arrow batches.

The sample of a tree is ``SAMPLE`` rows (drawn by hash, so repeated runs agree); growing on such samples is the method itself. The
forest is TREES x SAMPLE nodes at most, which bounds the broadcast. Nulls count as the column's 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.session import written

TREES, SAMPLE = 100, 256


def _path(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng, depth: int, limit: int, nodes: list) -> int:
    at = len(nodes)
    nodes.append(None)
    spread = x.max(0) - x.min(0) if len(x) else np.zeros(x.shape[1])
    if depth >= limit or len(x) <= 1 or not spread.any():
        nodes[at] = (-1, 0.0, depth + _path(len(x)), -1, -1)
        return at
    k = int(rng.choice(np.flatnonzero(spread)))
    cut = rng.uniform(x[:, k].min(), x[:, k].max())
    left = _grow(x[x[:, k] < cut], rng, depth + 1, limit, nodes)
    right = _grow(x[x[:, k] >= cut], rng, depth + 1, limit, nodes)
    nodes[at] = (k, cut, 0.0, left, right)
    return at


def isolation_scores(df: DataFrame, columns: list[str], seed: int = 42, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """id and anomaly score in (0, 1); higher is more isolated."""
    clean = written(df.select("id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]), "outliers")  # read for the samples and for the scores
    drawn = clean.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(trees * sample).select(*columns).toPandas().to_numpy()
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])
    rng = np.random.default_rng(seed)
    forest = []
    size = min(sample, len(drawn))
    for _ in range(trees if size else 0):
        nodes: list = []
        _grow(drawn[rng.choice(len(drawn), size, replace=False)], rng, 0, max(1, int(np.ceil(np.log2(max(2, size))))), nodes)
        forest.append(tuple(np.array(c) for c in zip(*nodes)))
    shared = df.sparkSession.sparkContext.broadcast((forest, _path(size) or 1.0))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grown, norm = shared.value
        for b in batches:
            x = b[columns].to_numpy()
            total = np.zeros(len(x))
            for feature, cut, length, left, right in grown:
                at = np.zeros(len(x), dtype=int)
                while (inner := feature[at] >= 0).any():
                    go = x[np.arange(len(x)), np.maximum(feature[at], 0)] < cut[at]
                    at = np.where(inner, np.where(go, left[at], right[at]), at)
                total += length[at]
            yield pd.DataFrame({"id": b["id"], "score": np.round(2.0 ** (-total / max(1, len(grown)) / norm), 6)})

    return clean.mapInPandas(score, schema)
