"""Rows out of texts that only a parser can give: definitions and imports of Python sources, strings inside nested JSON."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFS = T.StructType([T.StructField("chunk_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("end_line", T.IntegerType())])


def _definitions(text: str) -> list[tuple[str, str, int, int]]:
    try:
        tree = ast.parse(text.lstrip("﻿"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(("function", n.name, n.lineno, n.end_lineno))
        elif isinstance(n, ast.ClassDef):
            out.append(("class", n.name, n.lineno, n.end_lineno))
        elif isinstance(n, ast.Import):
            out += [("import", a.name, n.lineno, n.end_lineno) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out += [("import", f"{'.' * n.level}{n.module or ''}.{a.name}", n.lineno, n.end_lineno) for a in n.names]
    return out


def python_definitions(chunks: DataFrame) -> DataFrame:
    """chunk_id, kind, name, line, end_line of functions, classes and imports; texts that do not parse give none."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [(i, *d) for i, t in zip(df["chunk_id"], df["content"]) if t for d in _definitions(t)]
            yield pd.DataFrame(rows, columns=DEFS.names)

    return chunks.where("lower(file_path) LIKE '%.py'").select("chunk_id", "content").mapInPandas(extract, DEFS)


# Strings of JSON, and what follows a key.
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_KEY_END = re.compile(r"\s*:")


def clean_json(text: str, change) -> str:
    """``text`` with ``change`` applied to every string value, at any depth; keys, numbers and layout stay as they are. The text is read
    token by token, so there is no tree and no limit of depth."""

    def value(m: re.Match) -> str:
        if _KEY_END.match(text, m.end()):
            return m.group()
        old = json.loads(m.group(), strict=False)
        new = change(old)
        return m.group() if new == old else json.dumps(new, ensure_ascii=False)

    return _STRING.sub(value, text)


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
        return True
    except RecursionError:
        return True  # too deep to build, not broken: strings are read one by one
    except ValueError:
        return False


def sanitize_json(df: DataFrame, key: str, text: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Redaction of the strings inside JSON of any shape and depth; keys and structure stay. Broken JSON is treated as one string."""
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("text", T.StringType())])

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(re.compile(p), m) for p, m in rules]

        def change(value: str) -> str:
            for rx, marker in compiled:
                value = rx.sub(marker, value)
            return value

        for b in batches:
            yield pd.DataFrame({key: b[key], "text": [None if t is None else clean_json(t, change) if _is_json(t) else change(t) for t in b[text]]})

    return df.select(key, text).mapInPandas(clean, schema)
