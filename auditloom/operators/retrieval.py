"""Retrieval: tokens, chunks, BM25, exact vector search, rank fusion.

An index is three tables (postings with lengths, document frequencies, corpus figures) that live as Parquet; a
search is a join of query tokens with postings. Queries are a table: many are answered in one job. Vectors are
searched exactly in blocks of queries of checked size against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

K1, B = 1.5, 0.75
RRF_K, W_TEXT, W_VECTOR = 60, 0.4, 0.6
QUERY_BLOCK = 4096
MAX_BROADCAST = 1_000_000  # query tokens; both sides of the switch give the same result


def code_tokens(text: Column) -> Column:
    """camelCase and underscores split, signs dropped but dots kept, lower case, single characters out."""
    split = F.regexp_replace(F.regexp_replace(text, r"([a-z])([A-Z])", "$1 $2"), "_", " ")
    clean = F.lower(F.regexp_replace(split, r"[^\p{L}\p{N}\s.]", " "))
    return F.filter(F.split(clean, r"\s+"), lambda t: F.char_length(t) > 1)


def searchable(chunk_type: Column, name: Column, docstring: Column, content: Column) -> Column:
    """A heading line with type and name, the docstring, the content."""
    return F.concat_ws("\n", F.concat(F.lit("# "), chunk_type, F.lit(": "), F.coalesce(name, F.lit(""))), docstring, content)


def line_chunks(df: DataFrame, key: str, text: str, size: int = 30, step: int = 27) -> DataFrame:
    """Chunks of ``size`` lines that begin every ``step`` lines."""
    lines = F.split(F.col(text), "\n", -1)
    starts = F.sequence(F.lit(0), F.size("l") - 1, F.lit(step))
    cut = df.select(key, lines.alias("l")).select(key, "l", F.explode(starts).alias("s"))
    return cut.select(key, (F.col("s") + 1).alias("start_line"), F.least(F.col("s") + size, F.size("l")).alias("end_line"), F.array_join(F.slice("l", F.col("s") + 1, size), "\n").alias("content"))


def split_large(df: DataFrame, key: str, text: str, start: str, name: str, most: int = 1500, overlap: int = 3) -> DataFrame:
    """Contents of more than ``most`` characters cut into windows of lines that overlap, numbered; name_partN where there is a name."""
    size = max(20, most // 50)
    step = size - overlap
    large = df.where(F.char_length(text) > most).select(key, F.coalesce(start, F.lit(1)).alias("first"), F.col(name).alias("name"), F.split(F.col(text), "\n", -1).alias("l"))
    cut = large.select(key, "first", "name", "l", F.explode(F.sequence(F.lit(0), F.size("l") - 1, F.lit(step))).alias("s"))
    part = (F.col("s") / step).cast("int") + 1
    return cut.select(
        key, part.alias("part"), F.concat(F.col("name"), F.lit("_part"), part.cast("string")).alias("name"), (F.col("first") + F.col("s")).alias("start_line"),
        (F.col("first") + F.least(F.col("s") + size, F.size("l")) - 1).alias("end_line"), F.array_join(F.slice("l", F.col("s") + 1, size), "\n").alias("content"),
    )


# Terms of code search and the words that a query with such a term is widened by.
SYNONYMS = {
    "function": "func method def", "class": "type struct interface", "error": "exception error fail bug", "test": "test spec unit", "config": "configuration settings options", "auth": "authentication authorization login", "db": "database sql query", "api": "endpoint route handler",
}


def expanded(query: Column) -> Column:
    """The query and the synonyms of every term that it holds."""
    low = F.lower(query)
    return F.concat(query, *[F.when(F.contains(low, F.lit(term)), F.lit(" " + words)).otherwise("") for term, words in SYNONYMS.items()])


FENCED = "```(?:json)?\\s*\\n?([\\s\\S]*?)\\n?```"


def fenced(text: Column) -> Column:
    """The inside of the first fenced block, else the text, without blanks around."""
    return F.trim(F.when(F.rlike(text, F.lit(FENCED)), F.regexp_extract(text, FENCED, 1)).otherwise(text))


def token_chunks(df: DataFrame, key: str, text: str, size: int = 500) -> DataFrame:
    """Chunks of ``size`` blank-separated tokens without overlap."""
    toks = F.filter(F.split(F.col(text), r"\s+"), lambda t: t != "")
    cut = df.select(key, toks.alias("t")).where(F.size("t") > 0).select(key, "t", F.explode(F.sequence(F.lit(0), F.size("t") - 1, F.lit(size))).alias("s"))
    return cut.select(key, (F.col("s") / size).cast("int").alias("chunk"), F.array_join(F.slice("t", F.col("s") + 1, size), " ").alias("content"))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, token, tf, dl: the inverted index; token counts are folded inside each document before any shuffle."""
    toks = docs.select(key, code_tokens(F.col(text)).alias("t")).withColumn("dl", F.size("t"))
    return toks.select(key, "dl", F.explode("t").alias("token")).groupBy(key, "dl", "token").agg(F.count(F.lit(1)).alias("tf"))


def corpus(docs: DataFrame, text: str) -> DataFrame:
    """One row: number of documents and mean length in tokens."""
    return docs.select(F.size(code_tokens(F.coalesce(F.col(text), F.lit("")))).alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl"))


def write_index(docs: DataFrame, key: str, text: str, path: str) -> None:
    """Tokenise once and write the index: lengths of all documents, postings with those of a document together, and document frequencies."""
    spark = docs.sparkSession
    docs.select(key, code_tokens(F.coalesce(F.col(text), F.lit(""))).alias("t")).write.parquet(f"{path}/tokens")
    tokens = spark.read.parquet(f"{path}/tokens")
    tokens.select(key, F.size("t").alias("dl")).write.parquet(f"{path}/lengths")
    together = tokens.select(key, F.size("t").alias("dl"), "t").repartition(key)
    together.select(key, "dl", F.explode("t").alias("token")).groupBy(key, "dl", "token").agg(F.count(F.lit(1)).alias("tf")).write.parquet(f"{path}/postings")
    document_frequency(spark.read.parquet(f"{path}/postings")).write.parquet(f"{path}/df")


def read_index(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, the row of corpus figures, and document frequencies of a written index."""
    figures = spark.read.parquet(f"{path}/lengths").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl"))
    return spark.read.parquet(f"{path}/postings"), figures, spark.read.parquet(f"{path}/df")


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25(index: DataFrame, figures: DataFrame, queries: DataFrame, key: str, k: int, frequencies: DataFrame | None = None, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """query_id, key, score, rank: the k best documents of each query, ties by key.

    Query tokens keep their multiplicity and meet the document frequencies first, so that a posting is multiplied only once. Up to
    ``max_broadcast`` query tokens are broadcast: then postings are not shuffled at all, and as those of a document lie together, its scores are
    summed before the shuffle by (query, document). Beyond it both sides are shuffled by token, long posting lists being split by adaptive skew handling."""
    terms = queries.select("query_id", F.explode(code_tokens(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qn"))
    counts = frequencies if frequencies is not None else document_frequency(index.join(terms.select("token").distinct(), "token", "left_semi"))
    weighted = terms.join(counts, "token").crossJoin(F.broadcast(figures)).select("query_id", "token", (F.col("qn") * idf(F.col("n_docs"), F.col("df")) * (K1 + 1)).alias("w"), "avg_dl")
    if terms.limit(max_broadcast + 1).count() <= max_broadcast:
        weighted = F.broadcast(weighted)
    tf = F.col("tf")
    part = F.col("w") * tf / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    scored = index.join(weighted, "token").groupBy("query_id", key).agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    return ranked(scored, k, key)


def ranked(scores: DataFrame, k: int, key: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    """query_id, vec_id, score, rank: exact k best vectors of each query by inner product or (negated) squared distance.

    Queries are broadcast in blocks of at most QUERY_BLOCK; every task keeps its own k best per query, so what is
    shuffled is k rows per query and task, however many vectors there are. Null and empty vectors match nothing."""
    spark = vectors.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = [(r.query_id, np.array(r.embedding, dtype=np.float64)) for r in part.select("query_id", "embedding").where("embedding IS NOT NULL AND size(embedding) > 0").collect()]
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((np.array([q for q, _ in rows]), np.stack([v for _, v in rows])))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            top: pd.DataFrame | None = None
            for df in batches:
                df = df[df["embedding"].map(lambda v: v is not None and len(v) == q.shape[1])]
                if not len(df):
                    continue
                m = np.stack(df["embedding"].to_numpy()).astype(np.float64)
                s = q @ m.T
                if metric == "l2":
                    s = -((q * q).sum(1)[:, None] - 2 * s + (m * m).sum(1)[None, :])
                s = np.round(s, 6) + 0.0
                vec = df["vec_id"].to_numpy()
                order = np.lexsort((np.broadcast_to(vec, s.shape), -s), axis=1)[:, :k]
                new = pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "vec_id": vec[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})
                top = new if top is None else pd.concat([top, new])
                top = top.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
            if top is not None:
                yield top

        found = vectors.select("vec_id", "embedding").mapInPandas(best, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id bigint, vec_id bigint, score double, rank int")
    return ranked(out, k, "vec_id")


def fuse(text_hits: DataFrame, vector_hits: DataFrame, k: int) -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked lists (query_id, doc_id, rank)."""
    a = text_hits.select("query_id", "doc_id", F.col("rank").alias("ra"))
    b = vector_hits.select("query_id", "doc_id", F.col("rank").alias("rb"))
    part = lambda w, r: F.coalesce(F.lit(w) / (F.lit(float(RRF_K)) + F.col(r)), F.lit(0.0))
    both = a.join(b, ["query_id", "doc_id"], "full_outer").withColumn("score", F.round(part(W_TEXT, "ra") + part(W_VECTOR, "rb"), 8))
    return ranked(both, k, "doc_id").select("query_id", "doc_id", "score", "rank")


def centroids(vectors: DataFrame) -> DataFrame:
    """label and mean vector: dimensions are averaged with map-side combine."""
    long = vectors.where("label IS NOT NULL").select("label", F.posexplode("embedding").alias("i", "x"))
    means = long.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def classify(vectors: DataFrame, means: DataFrame) -> DataFrame:
    """vec_id and the label whose centroid is nearest by cosine; the few centroids are broadcast (one per class)."""
    near = vectors.select("vec_id", "embedding").crossJoin(F.broadcast(means))
    cos = F.round(dot(F.col("embedding"), F.col("centroid")) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("centroid"), F.col("centroid"))), 6)
    scored = near.select("vec_id", "label", cos.alias("cos"))
    return scored.groupBy("vec_id").agg(F.max(F.struct("cos", (-F.col("label")).alias("neg"))).alias("b")).select("vec_id", (-F.col("b.neg")).alias("label"), F.col("b.cos").alias("cosine"))
