"""Problem 2: source files that do not parse, by packrat parsing-expression grammars.

A file is (repo, file_path) as stored; its rows are laid out by start_line, lines between rows are blank, and
identical rows count once (``collect_set`` folds copies before the shuffle, so a file indexed a million times
costs one copy). The grammar of the extension must consume the whole input.

Rows whose path has no such extension, or no path, are never gathered: their contents are not needed for a verdict.

Defined cases: a null content is an empty one; rows without repo form files of their own under the null key;
an extension outside py, js, ts, json, toml (any letter case), no extension or a null path gives language null and
valid null, never a finding; an empty JSON file is invalid, an empty file of the others valid; overlapping rows:
the one that starts later wins, then the greater text; where more than 10 000 blank lines would be
needed between rows, that many are parsed and positions count all of them; nesting of any depth is parsed, and a
text for which memory does not suffice gives valid null and cause undecided. Extra columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.syntax.grammars import LANGUAGES, verdict

MAX_GAP = 10_000  # blank lines in sequence that are parsed; more of them cannot change a verdict


def language_of(path: str = "file_path"):
    ext = F.lower(F.regexp_extract(F.col(path), r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, F.lit(name)).otherwise(out)
    return out


def laid_out(starts, contents) -> tuple[str, list[tuple[int, int]]]:
    """The text of a file from its rows, sorted by start line, and (line from which it holds, number) of blank lines left out."""
    if len(starts) == 1 and starts[0] <= 1:
        return contents[0], []
    lines: list[str] = []
    shift, left_out = 0, []
    for start, content in zip(starts, contents):
        at = max(int(start), 1) - 1 - shift
        if at > len(lines) + MAX_GAP:
            shift += at - len(lines) - MAX_GAP
            at = len(lines) + MAX_GAP
            left_out.append((at, shift))
        own = content.split("\n")
        if at > len(lines):
            lines.extend([""] * (at - len(lines)))
        lines[max(at, 0) : max(at, 0) + len(own)] = own
    return "\n".join(lines), left_out


def assemble(starts, contents) -> str:
    return laid_out(starts, contents)[0]


VERDICT = T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("fail_line", T.LongType()), T.StructField("fail_at", T.LongType()), T.StructField("cause", T.StringType())])


@F.pandas_udf(VERDICT)
def _verdicts(starts: pd.Series, contents: pd.Series, language: pd.Series) -> pd.DataFrame:
    out = []
    for s, c, lang in zip(starts, contents, language):
        text, left_out = laid_out(s, c)
        ok, at, cause = verdict(text, lang)
        line = text.count("\n", 0, max(at, 0))
        missing = max((n for k, n in left_out if k <= line), default=0)
        out.append((ok, None, None, cause or None) if ok in (True, None) else (False, line + missing + 1, at + missing, cause))
    frame = pd.DataFrame(out, columns=VERDICT.names, dtype=object)
    return frame.astype({"valid": "boolean", "fail_line": "Int64", "fail_at": "Int64"})


def file_verdicts(chunks: DataFrame) -> DataFrame:
    """One row per file: repo, file_path, language, valid, fail_line, fail_at (characters), cause."""
    named = chunks.withColumn("language", language_of())
    rows = F.struct(F.coalesce("start_line", F.lit(1)).alias("s"), F.coalesce("content", F.lit("")).alias("c"))
    files = named.where("language IS NOT NULL").groupBy("repo", "file_path", "language").agg(F.array_sort(F.collect_set(rows)).alias("rows"))
    judged = files.withColumn("v", _verdicts(F.col("rows.s"), F.col("rows.c"), F.col("language"))).select("repo", "file_path", "language", "v.*")
    others = named.where("language IS NULL").select("repo", "file_path", "language").distinct()
    return judged.unionByName(others.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in VERDICT]))


def invalid_files(chunks: DataFrame) -> DataFrame:
    return file_verdicts(chunks).where("valid = false").select("repo", "file_path")


def invalid_rates(chunks: DataFrame) -> DataFrame:
    """Files, invalid files and rate for each repo and language, and by cause."""
    v = file_verdicts(chunks).where("language is not null")
    causes = [F.count_if(F.col("cause") == c).alias(f"n_{c}") for c in ("truncated", "merge_conflict", "wrong_language", "syntax", "undecided")]
    return v.groupBy("repo", "language").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"), F.round(F.avg((~F.col("valid")).cast("double")), 6).alias("invalid_rate"), *causes
    )
