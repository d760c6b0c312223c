"""Problem 8: evaluation texts leaking into documents, by spaced-seed hashing.

Texts become words (runs of letters and digits, lower case, invisible characters removed). Every window of twelve
words is hashed once per mask; a mask ignores three or four of the twelve positions, so a window with substituted words at
ignored positions still meets: of the four masks one meets whatever every third word is, one whatever every fourth word is, two are
irregular. The hashes of the documents join those of the items, broadcast behind a check of their number and shuffled beyond
it. Hits fold to distinct pairs of windows before anything else is joined (a phrase repeated k times against l times
is one pair, not k x l), those to (document, item, diagonal), which are written: only documents with a hit carry
their words any further. Each diagonal is verified word by word: the longest exact run, and the longest overlap in which
single words may be substituted. All masks lie inside twelve words, so an exact run of twelve always meets: no leak is missed.

Defined cases: null or empty texts have no words and match nothing; texts under twelve words match nothing;
repeated documents and items are cases of their own; windows that a text repeats are verified at their first place;
rows without an id are left out; the text is read whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.session import written

RUN = 12
MASKS = ((0, 1, 2, 4, 7, 8, 10, 11), (0, 1, 3, 5, 6, 8, 9, 11), (0, 1, 3, 4, 6, 7, 9, 10), (0, 1, 2, 4, 5, 6, 8, 9, 10))
MAX_BROADCAST = 1_000_000  # rows; both sides of the switch give the same result
INVISIBLE = r"[\x{AD}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]"


def _bounded(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def words(col):
    clean = F.regexp_replace(F.lower(F.coalesce(F.col(col), F.lit(""))), INVISIBLE, "")
    return F.filter(F.split(clean, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def window_hashes(df: DataFrame, key: str, text: str, pos: str, full: str) -> DataFrame:
    """key, position, hash of all twelve words and hash of each mask, of every window of twelve words. Words are hashed once; masks
    and windows hash those numbers, as plain expressions on exploded positions, which stay inside generated code."""
    hashed = df.select(key, F.transform(words(text), lambda x: F.xxhash64(x)).alias("w")).where(F.size("w") >= RUN)
    windows = hashed.select(key, "w", F.explode(F.sequence(F.lit(0), F.size("w") - RUN)).alias(pos))
    at = [F.get("w", F.col(pos) + o) for o in range(RUN)]
    masks = F.array(*[F.xxhash64(F.lit(k), *[at[o] for o in mask]) for k, mask in enumerate(MASKS)])
    return windows.select(key, pos, F.xxhash64(*at).alias(full), F.explode(masks).alias("h"))


def diagonals(documents: DataFrame, items: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, item_id and diagonal of every pair of windows that a seed meets, written."""
    test = written(window_hashes(items, "item_id", "text", "ipos", "ifull"), "item-seeds")
    hits = window_hashes(documents, "doc_id", "text", "dpos", "dfull").join(_bounded(test, max_broadcast), "h")
    folded = hits.groupBy("doc_id", "item_id", "dfull", "ifull").agg(F.min("dpos").alias("dpos"), F.min("ipos").alias("ipos"))
    return written(folded.select("doc_id", "item_id", (F.col("dpos") - F.col("ipos")).alias("diag")).distinct(), "diagonals")


def overlaps(documents: DataFrame, items: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, item_id, longest_run (exact words in sequence) and tolerant_words (words that agree in the longest
    overlap where no two neighbouring words differ) for every pair that a seed meets."""
    met = diagonals(documents, items, max_broadcast)
    texts = documents.select("doc_id", "text").join(_bounded(met.select("doc_id").distinct(), max_broadcast), "doc_id", "left_semi").select("doc_id", words("text").alias("dw"))
    found = texts.join(met, "doc_id").join(items.select("item_id", words("text").alias("iw")), "item_id")
    d0, i0 = F.greatest(F.col("diag"), F.lit(0)), F.greatest(-F.col("diag"), F.lit(0))
    n = F.least(F.size("dw") - d0, F.size("iw") - i0)
    same = F.zip_with(F.slice("dw", d0 + 1, n), F.slice("iw", i0 + 1, n), lambda a, b: a == b)
    start = F.struct(*[F.lit(0).alias(x) for x in ("run", "best", "near", "gap", "tolerant")])

    def step(a, eq):
        run = F.when(eq, a["run"] + 1).otherwise(0)
        near = F.when(eq, a["near"] + 1).when(a["gap"] >= 1, 0).otherwise(a["near"])
        return F.struct(run.alias("run"), F.greatest(a["best"], run).alias("best"), near.alias("near"), F.when(eq, 0).otherwise(a["gap"] + 1).alias("gap"), F.greatest(a["tolerant"], near).alias("tolerant"))

    r = F.aggregate(same, start, step)
    return found.select("doc_id", "item_id", r.alias("r")).groupBy("doc_id", "item_id").agg(F.max("r.best").alias("longest_run"), F.max("r.tolerant").alias("tolerant_words"))


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    return overlaps(documents, items).where(F.col("longest_run") >= RUN).select("doc_id", "item_id")


def leak_report(documents: DataFrame, items: DataFrame, min_tolerant: int = 16) -> DataFrame:
    """Per item: documents with an exact leak, documents with a substituted one only, and the longest run."""
    o = overlaps(documents, items)
    exact = F.col("longest_run") >= RUN
    return (
        o.where(exact | (F.col("tolerant_words") >= min_tolerant))
        .groupBy("item_id")
        .agg(F.count_if(exact).alias("n_exact"), F.count_if(~exact).alias("n_substituted"), F.max("longest_run").alias("longest_run"))
    )
