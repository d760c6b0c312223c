"""Problem 4: contents above the size limit of their type, split at natural boundaries by dynamic programming.

The cut positions of a text are its line ends, each with a penalty: least before a blank line or a definition at
the outer level, more inside an indented block, a statement, brackets or a string. Lines longer than half the limit
offer all their word gaps as well, and where words are longer than a quarter of the limit every position in them. Over these positions
the sum of cut penalties and of the squared deviation of each piece from an even size is minimised, subject to the limit. The deviation is
convex, so the best beginning of a piece never moves back: a queue of beginnings, each with the range of ends it is
best for, gives the exact optimum in n log n steps.

Every piece but the first begins with the last ``overlap_lines`` lines of the one before (the last of them may be cut), as many as leave
room for the step to the next boundary. Of a line that is too long for that its end is repeated instead, ``TAIL`` characters
for each line wanted, from a word gap on, at most half the limit. Limits are joined to the rows; Spark broadcasts them by their size.

Defined cases: null content and rows within their limit give no pieces; a null or unlisted chunk_type has no
limit; a null or non-positive max_chars is no limit; a null start_line counts as 1; a piece inside one long line
has that line's number as start and end; a character is a Unicode code point; line ends \\n, \\r\\n stay with their
line, so the new parts of the pieces concatenate to the content exactly; repeated rows are cases of their own.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAIL = 80  # characters of a long line that stand for one line of overlap
IMBALANCE = 4.0  # weight of the squared relative deviation from an even size

_TOP = re.compile(r"(?:@|def |class |async def |export |function |async function |const |interface |type |enum |\[|\"[^\"]*\"\s*:)")
_GAP = re.compile(r"[\s,;.)\]}]+")
_CLOSE = re.compile(r"\s*[)\]}]+[;,]?\s*\Z")


def line_starts(text: str) -> list[int]:
    """Offsets where lines begin (split at line feeds), and the length of the text."""
    out, at = [0], text.find("\n")
    while at >= 0:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    if out[-1] != len(text):
        out.append(len(text))
    return out


def boundaries(text: str, limit: int) -> tuple[list[int], list[float]]:
    """Positions where a cut may be made, in order, with their penalties; 0 and the end are among them."""
    starts = line_starts(text)
    pos, cost = [0], [0.0]
    depth = 0
    for k in range(len(starts) - 1):
        a, b = starts[k], starts[k + 1]
        line = text[a:b]
        if b - a > limit // 2:  # word gaps inside a long line; every position where there are none
            last = a
            gaps = [m.end() for m in _GAP.finditer(text, a, b)]
            if not gaps or gaps[-1] != b:
                gaps.append(b)
            for g in gaps:
                if g - last > max(1, limit // 4):
                    pos.extend(range(last + 1, g))
                    cost.extend([30.0] * (g - last - 1))
                if g < b:
                    pos.append(g)
                    cost.append(12.0)
                last = g
        body = line.strip()
        depth = max(0, depth + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
        nxt = text[b : starts[k + 2]] if k + 2 < len(starts) else ""
        indent = len(nxt) - len(nxt.lstrip(" \t"))
        if b == len(text):
            c = 0.0
        elif not body:
            c = 0.2 + 0.15 * indent if _TOP.match(nxt.lstrip()) or indent == 0 else 1.0 + 0.15 * indent
        elif not nxt.strip():
            c = 1.2 + 0.15 * indent
        elif _TOP.match(nxt) and depth == 0:
            c = 1.0
        elif _CLOSE.match(nxt):
            c = 8.0
        else:
            c = 2.5 + 0.25 * min(indent, 24) + 0.5 * min(depth, 6) + (2.0 if body[-1] in ",({[\\:=+" else 0.0)
        pos.append(b)
        cost.append(c)
    return pos, cost


def split(text: str, limit: int, overlap_lines: int) -> list[tuple[int, int, int]]:
    """(overlap start, start, end) offsets of the pieces; each has at most ``limit`` characters."""
    n = len(text)
    if n <= limit:
        return [(0, 0, n)]
    pos, cost = boundaries(text, limit)
    leads = overlaps(pos, line_starts(text), limit, overlap_lines)
    cuts = best_cuts(pos, cost, leads, limit)
    return [(leads[a] if a else 0, pos[a], pos[b]) for a, b in zip(cuts, cuts[1:])]


def best_cuts(pos: list[int], cost: list[float], leads: list[int], limit: int) -> list[int]:
    """Indices of the cuts with the least sum of penalties and deviations; ``leads`` never decreases."""
    last, target, far = len(pos) - 1, limit * 0.9, float("inf")
    best, back = [0.0] * (last + 1), [0] * (last + 1)
    unit = target * target / IMBALANCE

    def value(a: int, j: int) -> float:
        size = pos[j] - leads[a]
        if size > limit:
            return far
        if j == last and size <= target:  # the last piece may be small
            return best[a]
        u = (size - target) / target
        return best[a] + IMBALANCE * u * u

    begins, since, head = [0], [1], 0  # begins[k] is best for the ends from since[k] to before since[k + 1]
    for j in range(1, last + 1):
        while head + 1 < len(begins) and since[head + 1] <= j:
            head += 1
        a = begins[head]
        best[j], back[j] = value(a, j) + cost[j] + 1.5, a
        while len(begins) > head + 1 and value(j, since[-1]) <= value(begins[-1], since[-1]):
            begins.pop()
            since.pop()
        rival = begins[-1]
        if j == last or value(j, last) > value(rival, last):
            continue
        # both are squares of the same width, so from one end on the later beginning is better, at the latest where the other is too far
        apart = leads[j] - leads[rival]
        if apart:
            lo = bisect_left(pos, min(((best[j] - best[rival]) * unit / apart + leads[j] + leads[rival]) / 2 + target, limit + leads[rival] + 1), max(since[-1], j + 1), last)
        else:
            lo = max(since[-1], j + 1) if best[j] <= best[rival] else last
        begins.append(j)
        since.append(lo)
    cuts = [last]
    while cuts[-1] > 0:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def overlaps(pos: list[int], starts: list[int], limit: int, lines: int) -> list[int]:
    """Where a piece that begins anew at each position begins with its overlap; the step to the next position always fits."""
    if lines <= 0:
        return list(pos)
    out, k, line, whole = [0], 0, -1, True
    for a in range(1, len(pos)):
        p, step = pos[a], pos[min(a + 1, len(pos) - 1)]
        while starts[k + 1] < p:
            k += 1
        if k != line:  # can all of this line be repeated after its end?
            line, end = k, bisect_left(pos, starts[k + 1])
            whole = pos[min(end + 1, len(pos) - 1)] - starts[k] <= limit
        if whole:
            at = starts[max(0, k + 1 - lines, bisect_left(starts, step - limit))]
        else:
            at = pos[bisect_left(pos, p - max(0, min(lines * TAIL, limit // 2, limit - (step - p))))]
        out.append(max(out[-1], at))
    return out


_PIECES = T.ArrayType(
    T.StructType([T.StructField(c, T.StringType() if c == "content" else T.IntegerType()) for c in ("piece_no", "start_line", "end_line", "overlap_chars", "content")])
)


@F.pandas_udf(_PIECES)
def _pieces(content: pd.Series, first: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
    out = []
    for text, line, most, lines in zip(content, first, limit, overlap):
        starts = line_starts(text)
        rows = []
        for k, (begin, a, b) in enumerate(split(text, int(most), int(lines))):
            rows.append((k + 1, int(line) + bisect_right(starts, begin, 0, len(starts) - 1) - 1, int(line) + bisect_left(starts, b, 1) - 1, a - begin, text[begin:b]))
        out.append(rows)
    return pd.Series(out)


def pieces(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """chunk_id, chunk_type, n_pieces, piece_no, start_line, end_line, overlap_chars, content for rows above their limit."""
    known = limits.where("max_chars > 0").groupBy("chunk_type").agg(F.min("max_chars").alias("max_chars"), F.min(F.coalesce("overlap_lines", F.lit(0))).alias("overlap_lines"))
    rows = chunks.select("chunk_id", "chunk_type", "content", F.coalesce("start_line", F.lit(1)).alias("first")).join(known, "chunk_type")
    large = rows.where(F.char_length("content") > F.col("max_chars"))
    cut = large.select("chunk_id", "chunk_type", "max_chars", _pieces("content", "first", "max_chars", "overlap_lines").alias("p"))
    return cut.select("chunk_id", "chunk_type", "max_chars", F.size("p").alias("n_pieces"), F.explode("p").alias("p")).select("chunk_id", "chunk_type", "max_chars", "n_pieces", "p.*")


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """chunk_id of the rows that were cut."""
    return pieces(chunks, limits).where("n_pieces > 1").select("chunk_id").distinct()
