"""Problem 9: documents drawn from their sources so that each source has its target share of all tokens.

1. Tokens of every document with a public tokenizer (path is a parameter).
2. Documents of a source in shuffled order (by hash) are cut into blocks of equal tokens: a document belongs to
   the block in which its first token falls. The running sums are two-level (hash buckets first), so a source with
   a third of all rows is never one task.
3. The schedule: slot t is sent by the van der Corput point of t through the cumulative target shares to a
   source. Slots are ranked per source (again two-level); the j-th slot of a source draws its block j mod n, for
   the (j div n)-th time. Any prefix of the schedule has nearly the target shares already.
4. The length of the schedule is a rule of the caller's: without ``total_tokens`` it is what the scarcest source allows under
   its repeat cap, so that every share is met; with it, the schedule is that long, a source that is used up under its cap
   stops there, and its actual share is reported as it came out.

Defined cases: documents without source, or of a source without target, are not drawn; a target without
documents gets an actual share of 0 and the others are scaled up to 1 (column ``scaled_share``); shares or caps that are null or
not positive count as no target; null and empty texts have no tokens and draw nothing of the shares; equal hashes
are ordered by doc_id. Targets stay a table of any length: slots find their source by a join on cells of the unit interval.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.session import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SLOTS = 20_000  # slots that a schedule has at least where blocks can be small enough
BLOCK = (64, 1_000_000)  # least and greatest tokens of a block
CHUNK = 1 << 16  # slots ranked in one group
CELLS = 4096  # of the unit interval, by which slots meet the shares
# Fixed value: the published word pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(path: str = TOKENIZER):
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoding(path)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    count.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(count, T.LongType())


def _bits(n: int, per_group: int, least: int) -> int:
    return min(40, max(least, (max(1, n) // per_group).bit_length()))


def plan(counted: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> tuple[DataFrame, int, int, int]:
    """Sources with their scaled shares, caps and blocks; tokens of a block; slots; documents of these sources."""
    usable = targets.where("target_share > 0 AND max_repeats > 0 AND source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("cap"))
    sums = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    known = written(usable.join(sums, "source").where("tokens > 0"), "sources")
    whole = known.agg(F.sum("share").alias("all"))
    sources = known.crossJoin(F.broadcast(whole)).select("source", (F.col("share") / F.col("all")).alias("share"), "cap", "tokens", "docs")
    f = sources.agg(F.min(F.col("tokens") * F.col("cap") / F.col("share")).alias("most"), F.sum("docs").alias("docs")).first()
    if f.docs is None:
        return sources.withColumn("blocks", F.lit(0)), 1, 0, 0
    total = f.most if total_tokens is None else total_tokens
    block = int(min(max(total // SLOTS, BLOCK[0]), BLOCK[1]))
    return sources.withColumn("blocks", F.ceil(F.col("tokens") / F.lit(block))), block, max(int(total / block), 1), f.docs


def blocks(counted: DataFrame, block: int, n_docs: int, seed: int = 7) -> DataFrame:
    """source, doc_id, n_tokens and block of every document, by running sums over hash buckets."""
    bits = _bits(n_docs, 50_000, 5)
    keyed = counted.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    order = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    inner = keyed.withColumn("before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s"))
    base = sums.select("source", "bucket", F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return inner.join(base, ["source", "bucket"]).select("source", "doc_id", "n_tokens", F.floor((F.col("base") + F.col("before")) / F.lit(block)).cast("bigint").alias("block"))


def cells(sources: DataFrame) -> DataFrame:
    """source, lo and hi of its part of the unit interval, once for each cell that the part touches; running sums over hash buckets."""
    keyed = sources.select("source", "share", "cap", "blocks", F.pmod(F.xxhash64("source"), F.lit(64)).alias("bucket"))
    inner = F.coalesce(F.sum("share").over(Window.partitionBy("bucket").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    base = keyed.groupBy("bucket").agg(F.sum("share").alias("s")).select("bucket", F.coalesce(F.sum("s").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("base"))
    parts = keyed.withColumn("inner", inner).join(F.broadcast(base), "bucket").withColumn("lo", F.col("base") + F.col("inner")).withColumn("end", F.col("lo") + F.col("share"))
    hi = F.when(F.col("end") > 1 - 1e-9, 2.0).otherwise(F.col("end"))  # the last part takes what rounding leaves
    last = F.least(F.floor(F.col("end") * CELLS), F.lit(CELLS - 1))
    return parts.select("source", "cap", "blocks", "lo", hi.alias("hi"), F.explode(F.sequence(F.least(F.floor(F.col("lo") * CELLS), last), last)).alias("cell"))


def schedule(spark, sources: DataFrame, slots: int) -> DataFrame:
    """slot, source, block and repeat of every slot."""
    width = max(1, int(slots).bit_length())
    u = F.conv(F.reverse(F.lpad(F.bin("id"), width, "0")), 2, 10).cast("double") / float(1 << width)
    points = spark.range(slots).select(F.col("id").alias("slot"), u.alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    sent = points.join(cells(sources), "cell").where("u >= lo AND u < hi").select("slot", "source", "cap", "blocks", F.floor(F.col("slot") / CHUNK).cast("bigint").alias("chunk"))
    within = sent.withColumn("r", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")))
    counts = sent.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("source", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = within.join(base, ["source", "chunk"]).withColumn("j", F.col("base") + F.col("r") - 1)
    out = ranked.select("slot", "source", (F.col("j") % F.col("blocks")).alias("block"), F.floor(F.col("j") / F.col("blocks")).cast("bigint").alias("repeat"), "cap")
    return out.where("repeat < cap").select("slot", "source", "block", "repeat")


def counted_tokens(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, n_tokens, written once: both the plan and the blocks read it."""
    return written(documents.select("doc_id", "source", n_tokens(path)("text").alias("n_tokens")), "tokens")


_EMPTY = "doc_id bigint, source string, n_tokens bigint, slot bigint, repeat bigint"


def draws(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER, counted: DataFrame | None = None, total_tokens: int | None = None) -> DataFrame:
    """One row per drawn copy of a document: doc_id, source, n_tokens, slot, repeat."""
    counted = counted if counted is not None else counted_tokens(documents, path)
    sources, block, slots, n_docs = plan(counted, targets, total_tokens)
    spark = documents.sparkSession
    if not n_docs:
        return spark.createDataFrame([], _EMPTY)
    used = blocks(counted.join(sources.select("source"), "source", "left_semi"), block, n_docs)
    return used.join(schedule(spark, sources, slots), ["source", "block"]).select("doc_id", "source", "n_tokens", "slot", "repeat")


def mixed(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER, total_tokens: int | None = None) -> DataFrame:
    """Every drawn document with its number of repeats and first slot."""
    return draws(documents, targets, path, total_tokens=total_tokens).groupBy("doc_id", "source", "n_tokens").agg(F.count(F.lit(1)).alias("repeats"), F.min("slot").alias("first_slot"))


def shares(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER, total_tokens: int | None = None) -> DataFrame:
    """Target and actual share of every source that has a target."""
    counted = counted_tokens(documents, path)
    scaled = plan(counted, targets, total_tokens)[0].select("source", F.col("share").alias("scaled_share"))
    d = draws(documents, targets, path, counted, total_tokens)
    drawn = d.groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens"), (F.max("repeat") + 1).alias("passes"), F.count_distinct("doc_id").alias("n_docs"))
    total = drawn.agg(F.sum("drawn_tokens").alias("all_tokens"))
    known = targets.where("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    joined = known.join(scaled, "source", "left").join(drawn, "source", "left").crossJoin(F.broadcast(total))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        "source", "target_share", zero("scaled_share").alias("scaled_share"), F.coalesce(F.col("drawn_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
        zero("drawn_tokens").alias("drawn_tokens"), zero("n_docs").alias("n_docs"), zero("passes").alias("passes"), "max_repeats",
    )
