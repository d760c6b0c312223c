"""Behaviour analytics: features of every call in the sequence of its user, transition counts, scores and reasons.

Sequences run in blocks with a halo (see ``windows``), first-seen facts are aggregates joined back, so no user is
one task. Input are calls with user_id, id, us, tool, ip_address, path and size; rows without time are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.windows import BLOCK, in_blocks, sequence

MINUTE = 60_000_000

# Patterns of paths by sensitivity.
SENSITIVE = (
    (1.0, r"(?i)(?:\.env|secret|credential|private[_-]?key|\.pem|id_rsa|password|token)"),
    (0.7, r"(?i)(?:config|settings|\.ya?ml|\.toml|\.ini|auth|admin|database|migration)"),
    (0.4, r"(?i)(?:src/|lib/|server/|proxy/|\.py|\.js|\.ts)"),
)


def with_path(calls: DataFrame) -> DataFrame:
    """Adds path (from a JSON input) and size (characters of the input)."""
    return calls.withColumns({"path": F.get_json_object("tool_input", "$.path"), "size": F.coalesce(F.char_length("tool_input"), F.lit(0))})


def sensitivity(path):
    out = F.when(path.isNull() | (path == ""), 0.0)
    for level, pattern in SENSITIVE:
        out = out.when(F.rlike(path, F.lit(pattern)), level)
    return out.otherwise(0.1)


def depth(path):
    parts = F.filter(F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    return F.least(F.size(parts) / 10.0, F.lit(1.0))


def unusual_hour(us):
    """Before 6, after 22 or on a weekend, UTC."""
    hour = F.floor(us / 3_600_000_000) % 24
    weekday = (F.floor(us / 86_400_000_000) + 3) % 7  # 1970-01-01 was a Thursday; Monday is 0
    return ((hour < 6) | (hour > 22) | (weekday >= 5)).cast("double")


def transitions(calls: DataFrame, block: int = BLOCK) -> DataFrame:
    """src, dst, n, p: how often one tool follows another for the same user, and its share of the followers of src."""
    seq = in_blocks(calls.where("us IS NOT NULL").select("user_id", "id", "us", "tool"), "user_id", "us", "id", block)
    pairs = seq.withColumn("src", F.lag("tool").over(sequence("user_id"))).where("own AND src IS NOT NULL").groupBy("src", F.col("tool").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("src")), 6))


def entropy(tools):
    """Shannon entropy of a list of tools, normalised by the log of the number of different ones; under six 0.5."""
    kinds = F.array_distinct(tools)
    n = F.size(tools).cast("double")
    shares = F.transform(kinds, lambda t: F.size(F.filter(tools, lambda x: x == t)) / n)
    h = F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return F.when(F.size(tools) < 6, 0.5).when(F.size(kinds) <= 1, 0.0).otherwise(F.round(h / F.log2(F.size(kinds).cast("double")), 6))


def features(calls: DataFrame, block: int = BLOCK, with_entropy: bool = True) -> DataFrame:
    """id, user_id and twelve features of every call, in a fixed order."""
    base = with_path(calls).where("us IS NOT NULL").select("user_id", "id", "us", "tool", "ip_address", "path", "size")
    first = base.groupBy("user_id").agg(F.min("us").alias("first_us"))
    first_ip = base.where("ip_address IS NOT NULL").groupBy("user_id", "ip_address").agg(F.min(F.struct("us", "id")).alias("ip_first"))
    sizes = base.groupBy("tool").agg(F.avg("size").alias("mean"), F.stddev_pop("size").alias("std"), F.count(F.lit(1)).alias("k"))
    matrix = transitions(calls, block).select(F.col("src").alias("prev_tool"), F.col("dst").alias("tool"), "p")
    w = sequence("user_id")
    seq = in_blocks(base, "user_id", "us", "id", block)
    minute = Window.partitionBy("user_id", "block").orderBy("us").rangeBetween(-(MINUTE - 1), 0)
    x = seq.withColumns({"prev_us": F.lag("us").over(w), "prev_tool": F.lag("tool").over(w), "request_rate": F.least(F.col("pos") - F.min("pos").over(minute), F.lit(60)).cast("double")})
    r, r1, r2 = F.col("request_rate"), F.lag("request_rate", 1).over(w), F.lag("request_rate", 2).over(w)
    x = x.withColumn("velocity_change", F.when(r2.isNull(), 0.0).otherwise(F.greatest(F.least((r - r1) - (r1 - r2), F.lit(10.0)), F.lit(-10.0))))
    if with_entropy:
        x = x.withColumn("sequence_entropy", entropy(F.collect_list("tool").over(w.rowsBetween(-100, 0))))
    x = x.where("own").join(first, "user_id").join(first_ip, ["user_id", "ip_address"], "left").join(F.broadcast(sizes), "tool").join(matrix, ["prev_tool", "tool"], "left")
    gap = (F.col("us") - F.col("prev_us")) / 1e6
    z = F.try_divide(F.col("size") - F.col("mean"), F.col("std"))
    return x.select(
        "id", "user_id",
        F.when(F.col("prev_us").isNull(), 3600.0).otherwise(F.least(F.greatest(gap, F.lit(0.0)), F.lit(7200.0))).alias("time_since_last"),
        unusual_hour(F.col("us")).alias("unusual_hour"),
        F.least((F.col("us") - F.col("first_us")) / 1e6, F.lit(14400.0)).alias("session_duration"),
        "request_rate", "velocity_change",
        F.coalesce((F.col("tool") != F.col("prev_tool")).cast("double"), F.lit(0.0)).alias("tool_changed"),
        *(["sequence_entropy"] if with_entropy else []),
        F.when(F.col("prev_tool").isNull(), 0.5).otherwise(F.coalesce("p", F.lit(0.1))).alias("transition_prob"),
        sensitivity(F.col("path")).alias("file_sensitivity"), depth(F.col("path")).alias("resource_depth"),
        F.coalesce(((F.col("ip_first.us") == F.col("us")) & (F.col("ip_first.id") == F.col("id"))).cast("double"), F.lit(0.0)).alias("new_ip"),
        F.round(F.when((F.col("k") < 10) | (F.col("std") == 0), 0.0).otherwise(F.greatest(F.least(z, F.lit(3.0)), F.lit(-3.0))), 6).alias("size_z"),
    )


FEATURES = ("time_since_last", "unusual_hour", "session_duration", "request_rate", "velocity_change", "tool_changed", "sequence_entropy", "transition_prob", "file_sensitivity", "resource_depth", "new_ip", "size_z")

# Rules of the score, as feature, condition, weight, reason.
RULES = (
    ("time_since_last", "time_since_last < 1", 0.3, "rapid calls"), ("request_rate", "request_rate >= 8", 0.3, "high rate"), ("unusual_hour", "unusual_hour = 1", 0.15, "unusual hour"), ("new_ip", "new_ip = 1", 0.15, "new address"),
    ("file_sensitivity", "file_sensitivity >= 0.7", 0.25, "sensitive file"), ("sequence_entropy", "sequence_entropy >= 0.85", 0.15, "erratic sequence"), ("transition_prob", "transition_prob < 0.1", 0.1, "rare transition"), ("velocity_change", "abs(velocity_change) >= 3", 0.2, "sudden change"),
)


def rule_score(f: DataFrame, rules=RULES) -> DataFrame:
    """id, score (capped at 1), flagged (sum of at least 0.5), reasons in order of the rules."""
    total = F.lit(0.0)
    for _, cond, weight, _ in rules:
        total = total + F.when(F.expr(cond), weight).otherwise(0.0)
    total = F.round(total, 6)
    return f.select("id", F.least(total, F.lit(1.0)).alias("score"), (total >= 0.5).alias("flagged"), F.concat_ws("; ", *[F.when(F.expr(c), r) for _, c, _, r in rules]).alias("reasons"))


def explanations(f: DataFrame, k: int = 5, rules=RULES) -> DataFrame:
    """id, rank, feature, importance of the k weightiest rules that hold."""
    hits = F.array_compact(F.array(*[F.when(F.expr(c), F.struct(F.lit(-w).alias("neg"), F.lit(n).alias("feature"))) for n, c, w, _ in rules]))
    top = f.select("id", F.slice(F.array_sort(hits), 1, k).alias("h")).select("id", F.posexplode("h").alias("i", "h"))
    return top.select("id", (F.col("i") + 1).alias("rank"), "h.feature", (-F.col("h.neg")).alias("importance"))


def scaled(f: DataFrame, columns: list[str]) -> DataFrame:
    """Standard scores with population deviation; constant columns give 0. The figures are one broadcast row."""
    figures = f.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    return f.crossJoin(F.broadcast(figures)).select("id", *[F.round(F.when(F.col(f"s_{c}") == 0, 0.0).otherwise((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")), 5).alias(c) for c in columns])


def minmax(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Every score normalised over the whole set; the bounds are one broadcast row, not a window over everything."""
    bounds = scores.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])
    return scores.crossJoin(F.broadcast(bounds)).select("id", *[F.round((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}") + 1e-10), 6).alias(c) for c in columns])


def ensemble(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean over the scores that are there."""
    have = [F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in weights.items()]
    total = [F.coalesce(F.col(c) * F.lit(w), F.lit(0.0)) for c, w in weights.items()]
    s = lambda xs: sum(xs[1:], xs[0])
    return scores.select("id", F.round(F.try_divide(s(total), s(have)), 8).alias("score"))
