"""Problem 5: functions and methods paired with their documentation.

Definitions come from error-recovering generalised LL parses (graph-structured stack) of each row's content, so
the sound functions of a broken file are found too. The description is the documentation string, else the
comment directly above the definition, else (in ``function`` rows whose content has neither) the docstring
column; of it only the prose counts, not the parts that list parameters, returns, raised errors or examples.
Pairs with fewer than five words of description are dropped. ``function_pairs`` also drops descriptions that
are templates repeated over the corpus: every description is reduced to a template (identifiers of the function
name, digits and quoted parts masked), templates are counted by hash over the whole corpus with map-side
combine, and those that at least ``min_template_count`` (ten) of them share go.

Defined cases: null content has no functions; null path or another extension than py, js, ts: no functions; a
null docstring column is none; rows repeated under another chunk_id are cases of their own in ``documented``,
one pair in ``function_pairs``; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.invalid_files import invalid_files, language_of
from auditloom.llm.syntax.islands import js_functions, python_functions

MIN_WORDS = 5

_SECTION = re.compile(
    r"^\s*(?:args|arguments|parameters|params|param|keyword args|keyword arguments|kwargs|returns?|yields?|raises|throws|errors|examples?|usage|attributes|see also|notes?|references|todo)\s*:{1,2}\s*$",
    re.I,
)
_INLINE = re.compile(r"^\s*(?:args|arguments|parameters|params|returns?|yields?|raises|throws|examples?)\s*:\s+\S", re.I)
_TAG = re.compile(r"^\s*(?:@(?!description\b|desc\b|summary\b|remarks\b)\w+|:(?:param|parameter|arg|argument|key|keyword|type|raises?|except|exception|var|ivar|cvar|returns?|rtype|yields?)\b[^:]*:)")
_WORD = re.compile(r"[^\W\d_](?:[^\W_]|['’-](?=[^\W_]))*")
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)


def prose(doc: str) -> str:
    """The describing part of a documentation text."""
    doc = _FENCE.sub("\n", doc.replace("\r\n", "\n").replace("\r", "\n"))
    doc = re.sub(r"@(?:description|desc|summary|remarks)\b", " ", doc)
    out: list[str] = []
    lines = [re.sub(r"^\s*\*(?: |\Z|(?=\S))(?!\*\Z)", lambda m: " " * (len(m.group()) - 1), x) if re.match(r"^\s*\*", x) else x for x in doc.split("\n")]
    i, n = 0, len(lines)
    while i < n:
        line = lines[i].expandtabs()
        text = line.strip()
        indent = len(line) - len(line.lstrip())
        if text and set(text) <= set("-=~*#/_"):
            i += 1
            continue
        if i + 1 < n and re.match(r"^\s*-{3,}\s*$", lines[i + 1]) and re.match(r"^(parameters|returns|yields|raises|examples?|notes|see also|attributes|references|other parameters)$", text, re.I):
            i += 2
            while i < n and not (i + 1 < n and re.match(r"^\s*-{3,}\s*$", lines[i + 1])):
                i += 1
            continue
        if _SECTION.match(text):
            i += 1
            while i < n and (not lines[i].strip() or len(lines[i].expandtabs()) - len(lines[i].expandtabs().lstrip()) > indent):
                i += 1
            continue
        if _TAG.match(text):
            i += 1
            while i < n and lines[i].strip() and not _TAG.match(lines[i]) and (text[0] == "@" or len(lines[i].expandtabs()) - len(lines[i].expandtabs().lstrip()) > indent):
                i += 1
            continue
        if text.startswith(">>>"):
            i += 1
            while i < n and lines[i].strip() and not lines[i].strip().startswith(">>>"):
                i += 1
            continue
        if not _INLINE.match(text):
            out.append(re.sub(r"^\*+\s*", "", text))
        i += 1
    return re.sub(r"\s+", " ", " ".join(out)).strip(" */#-")


def n_words(text: str) -> int:
    return len(_WORD.findall(text))


def described(content: str, language: str, chunk_type: str | None, docstring: str | None) -> list[tuple[str, str, int, int]]:
    """(name, description, start, end) of every function with at least five words of description."""
    out = []
    for f in (python_functions if language == "python" else js_functions)(content):
        own = [d for d in (f["doc"], f["comment"]) if d and d.strip()]
        if not own and chunk_type == "function" and docstring:
            own = [docstring]
        for d in own:
            p = prose(d)
            if n_words(p) >= MIN_WORDS:
                out.append((f["name"], p, f["start"], f["end"]))
                break
    return out


_FOUND = T.ArrayType(
    T.StructType([T.StructField("func_name", T.StringType()), T.StructField("description", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)


@F.pandas_udf(_FOUND)
def _described(content: pd.Series, language: pd.Series, chunk_type: pd.Series, docstring: pd.Series) -> pd.Series:
    return pd.Series([described(c, g, t, d) if c and g else [] for c, g, t, d in zip(content, language, chunk_type, docstring)])


def documented(chunks: DataFrame) -> DataFrame:
    """chunk_id, repo, file_path, func_name, description, code of every documented function in rows other than block."""
    rows = chunks.where(F.coalesce(F.col("chunk_type") != "block", F.lit(True))).select("chunk_id", "repo", "file_path", "content", "chunk_type", "docstring")
    rows = rows.withColumn("language", language_of()).where(F.col("language").isin("python", "javascript", "typescript"))
    found = rows.withColumn("f", F.explode(_described("content", "language", "chunk_type", "docstring")))
    return found.select("chunk_id", "repo", "file_path", "f.func_name", "f.description", F.expr("substring(content, f.start + 1, f.end - f.start)").alias("code"))


def documented_valid(chunks: DataFrame) -> DataFrame:
    """chunk_id and func_name of the documented functions of files that parse."""
    bad = invalid_files(chunks.where(language_of().isin("python", "javascript", "typescript")))
    found = documented(chunks).select("chunk_id", "repo", "file_path", "func_name")
    on = [found[c].eqNullSafe(bad[c]) for c in ("repo", "file_path")]
    return found.join(bad, on, "left_anti").select("chunk_id", "func_name").distinct()


def function_pairs(chunks: DataFrame, min_template_count: int = 10) -> DataFrame:
    """Distinct code-description pairs without description templates that at least ``min_template_count`` of them share."""
    spaced = F.lower(F.regexp_replace(F.regexp_replace("func_name", r"([a-z0-9])([A-Z])", "$1 $2"), "_", " "))
    d = F.lower(F.col("description"))
    template = F.regexp_replace(F.regexp_replace(F.replace(F.replace(d, F.lower("func_name"), F.lit("~")), spaced, F.lit("~")), r"['\"`][^'\"`]*['\"`]", "~"), r"\d+", "9")
    pairs = documented(chunks).select("func_name", "description", "code").distinct().withColumn("template", F.xxhash64(template))
    repeated = pairs.groupBy("template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_template_count).select("template")
    return pairs.join(repeated, "template", "left_anti").select("func_name", "description", "code")
