"""Function definitions with their documentation, found by island grammars over error-recovering tokens.

Definitions are the islands; everything else is water, and a definition whose header or body is broken is water
too, so that the others of a broken file are still found.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right

from auditloom.llm.syntax.gll import Gll
from auditloom.llm.syntax.lexers import lex_js, lex_python

_ANY_HEAD = ["NAME", "W", "def", "class", "async", "@", ":", "->", "STR"]

PYTHON_ISLANDS = {
    "S": [("E", "S"), ()],
    "E": [("F",), ("INDENT", "S", "DEDENT"), ("LINE",), ("DOC",), ("NEWLINE",), ("OPEN",), ("CLOSE",), *[(t,) for t in _ANY_HEAD]],
    "F": [("def", "NAME", "A", "R", ":", "B")],
    "A": [("OPEN", "X", "CLOSE")],
    "X": [("A", "X"), ("NAME", "X"), ("W", "X"), (":", "X"), ("STR", "X"), ("->", "X"), ()],
    "R": [("->", "Y"), ()],
    "Y": [("NAME", "Z"), ("W", "Z"), ("STR", "Z"), ("A", "Z")],
    "Z": [("NAME", "Z"), ("W", "Z"), ("STR", "Z"), ("A", "Z"), ()],
    "B": [("NEWLINE", "INDENT", "S", "DEDENT"), ("LINE",), ("DOC",)],
}

_JS_WATER = ["NAME", "W", "=", ":", "=>", "function", "class", "async", "<", ">", ",", "?"]
JS_ISLANDS = {
    "S": [("E", "S"), ()],
    "E": [("F",), ("G",), *[(t,) for t in _JS_WATER]],
    "G": [("{", "S", "}"), ("(", "S", ")"), ("[", "S", "]")],
    "F": [
        ("function", "NAME", "T", "P", "R", "K"),
        ("NAME", "T", "P", "R", "K"),
        ("NAME", "Q", "=", "H"),
        ("NAME", ":", "H"),
    ],
    "H": [("async", "H1"), ("H1",)],
    "H1": [("function", "N", "T", "P", "R", "K"), ("T", "P", "R", "=>", "E"), ("NAME", "=>", "E")],
    "N": [("NAME",), ()],
    "P": [("(", "S", ")")],
    "K": [("{", "S", "}")],
    "T": [("<", "U", ">"), ()],
    "U": [("U1", "U"), ()],
    "U1": [("<", "U", ">"), ("NAME",), ("W",), (",",), (":",), ("?",), ("=",), ("=>",), ("G",)],
    "R": [(":", "V"), ()],
    "V": [("V1", "V"), ("V1",)],
    "V1": [("NAME",), ("W",), ("<", "U", ">"), ("[", "S", "]"), ("(", "S", ")")],
    "Q": [(":", "V"), ()],
}

_PY = Gll(PYTHON_ISLANDS, "S", {"F"})
_JS = Gll(JS_ISLANDS, "S", {"F"})
_KEEP_JS = frozenset(["=", ":", "=>", "function", "class", "<", ">", ",", "?", "{", "}", "(", ")", "[", "]"])
_MODIFIERS = frozenset(["export", "default", "async", "static", "public", "private", "protected", "readonly", "abstract", "override", "declare", "const", "let", "var", "get", "set", "*"])


def _balance(kinds: list[str]) -> dict[int, int]:
    """Brackets without a partner become water; the others' partners."""
    partner, stack, closes = {}, [], {")": "(", "]": "[", "}": "{"}
    for i, k in enumerate(kinds):
        if k in "([{" and k:
            stack.append(i)
        elif k in closes:
            at = len(stack) - 1
            while at >= 0 and kinds[stack[at]] != closes[k]:
                at -= 1
            if at < 0:
                kinds[i] = "W"
                continue
            for j in stack[at + 1 :]:
                kinds[j] = "W"
            partner[stack[at]] = i
            del stack[at:]
    for j in stack:
        kinds[j] = "W"
    return partner


def python_functions(text: str) -> list[dict]:
    ends: list[int] = []
    T, V, _, P = lex_python(text, recover=True, ends=ends)
    kinds: list[str] = []
    src: list[int] = []  # token index of each coarse token
    i, n = 0, len(T) - 1

    def add(k, at):
        kinds.append(k)
        src.append(at)

    while i < n:
        k = T[i]
        if k in ("INDENT", "DEDENT", "NEWLINE"):
            add(k, i)
            i += 1
            continue
        j = i
        while j < n and T[j] != "NEWLINE":
            j += 1
        head = i
        if T[head] == "async":
            head += 1
        if T[head] == "def":
            if head != i:
                add("async", i)
            depth, k = 0, head
            while k < j:
                t = T[k]
                if t in ("(", "[", "{"):
                    depth += 1
                    add("OPEN", k)
                elif t in (")", "]", "}"):
                    depth -= 1
                    add("CLOSE", k)
                else:
                    add(t if t in ("def", ":", "->", "NAME") else "STR" if t == "STRING" else "W", k)
                    if t == ":" and depth <= 0:
                        break
                k += 1
            if k + 1 < j:
                add("DOC" if all(t == "STRING" for t in T[k + 1 : j]) else "LINE", k + 1)
        else:
            add("DOC" if all(t == "STRING" for t in T[i:j]) else "LINE", i)
        i = j
    # indentation without a partner is water
    stack = []
    for x, k in enumerate(kinds):
        if k == "INDENT":
            stack.append(x)
        elif k == "DEDENT":
            if stack:
                stack.pop()
            else:
                kinds[x] = "W"
    for x in stack:
        kinds[x] = "W"
    kinds.append("EOF")
    out = []
    for _, a, b in sorted(_PY.spans(kinds)):
        if out and out[-1]["at"] == a:
            continue
        t = src[a]
        doc = ""
        x = a
        while kinds[x] != ":" or src[x] < t:
            x += 1
        depth = 0
        for x in range(a, b):  # the colon that ends the header
            depth += (kinds[x] == "OPEN") - (kinds[x] == "CLOSE")
            if kinds[x] == ":" and depth == 0:
                break
        y = x + 1
        while y < b and kinds[y] in ("NEWLINE", "INDENT"):
            y += 1
        if y < b and kinds[y] == "DOC":
            s = src[y]
            e = s
            while T[e] == "STRING":
                e += 1
            try:
                value = ast.literal_eval("(" + text[P[s] : ends[e - 1]] + ")")
                doc = value if isinstance(value, str) else ""
            except (ValueError, SyntaxError, MemoryError):
                doc = ""
        first = t - 1 if t and T[t - 1] == "async" else t
        comment = _comment_above(text, P, ends, first, "#")
        k = first
        while not comment and k >= 2 and T[k - 1] == "NEWLINE":  # decorators
            j = k - 2
            while j >= 0 and T[j] not in ("NEWLINE", "INDENT", "DEDENT"):
                j -= 1
            if T[j + 1] != "@":
                break
            k = j + 1
            comment = _comment_above(text, P, ends, k, "#")
        last = src[b - 1] if b - 1 < len(src) else n
        out.append({"at": a, "name": V[t + 1], "doc": doc, "comment": comment, "start": P[k], "end": ends[min(max(last - 1, t), len(ends) - 1)]})
    return out


def _comment_above(text: str, P: list[int], ends: list[int], token: int, mark: str) -> str:
    """The comment that ends on the line before a token, with no blank line between."""
    lo = 0
    k = token - 1
    while k >= 0 and ends[k] >= P[token]:
        k -= 1
    if k >= 0:
        lo = ends[k]
    gap = text[lo : P[token]]
    if mark not in gap:
        return ""
    lines = gap.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    own_first = lo == 0 or text[lo - 1 : lo] == "\n"
    if lines[-1].strip():  # a block comment on the same line as the definition
        m = re.search(r"/\*(.*?)\*/\s*\Z", gap, re.S)
        return m.group(1) if m and mark == "/" else ""
    lines.pop()
    if not own_first:
        lines[:1] = [""] if not lines[:1] else [lines[0] if "\n" in text[max(0, lo - 1) : lo] else ""]
    if not lines or not lines[-1].strip():
        return ""
    if mark == "/" and lines[-1].rstrip().endswith("*/"):
        body = "\n".join(lines)
        start = body.rfind("/*")
        return body[start + 2 :].rstrip()[:-2] if start >= 0 else ""
    lead = "//" if mark == "/" else "#"
    got = []
    while lines and lines[-1].strip().startswith(lead):
        got.append(lines.pop().strip().lstrip(lead[0]))
    return "\n".join(reversed(got))


def js_functions(text: str) -> list[dict]:
    ends: list[int] = []
    T, V, _, P = lex_js(text, recover=True, ends=ends)
    n = len(T) - 1
    raw = ["NAME" if V[i] is not None and T[i] == "NAME" and V[i] != "async" else "async" if V[i] == "async" else T[i] if T[i] in _KEEP_JS else "NAME" if T[i] == "PRIV" else "W" for i in range(n)]
    partner = _balance(raw)
    interesting = [i for i in range(n) if raw[i] in ("function", "=>", "{")]
    kinds, src = [], []
    i = 0
    while i < n:
        k = raw[i]
        if k in "([" and i in partner:
            j = partner[i]
            x = bisect_right(interesting, i)
            inside = x < len(interesting) and interesting[x] < j
            if not inside and not (k == "(" and raw[j + 1 : j + 2] and raw[j + 1] in ("{", "=>", ":")):
                if not kinds or kinds[-1] != "W":
                    kinds.append("W")
                    src.append(i)
                i = j + 1
                continue
        if k == "W" and kinds and kinds[-1] == "W":
            i += 1
            continue
        kinds.append(k)
        src.append(i)
        i += 1
    kinds.append("EOF")
    out, seen = [], set()
    for _, a, b in sorted(_JS.spans(kinds)):
        if a in seen:
            continue
        seen.add(a)
        t = src[a]
        name_at = t + 1 if T[t] == "function" else t
        if T[name_at] == "*":
            name_at += 1
        first = t
        while first > 0 and (T[first - 1] in _MODIFIERS or V[first - 1] in _MODIFIERS):
            first -= 1
        if T[t] != "function" and first > 0 and T[first - 1] in (".", "new", "?.", "function"):
            continue
        comment = _comment_above(text, P, ends, first, "/")
        last = src[b - 1] if b - 1 < len(src) else n - 1
        out.append({"at": a, "name": V[name_at] or text[P[name_at] : ends[name_at]], "doc": "", "comment": comment, "start": P[first], "end": ends[last]})
    return out
