"""Tokens of Python and of JavaScript/TypeScript.

A lexer gives parallel lists: kinds T (a reserved word or punctuation stands for itself), word texts V (None
for tokens that are no words), a flag NL for "a line end precedes", and offsets P. It never fails: what is no
token becomes the kind ERR, which no grammar accepts. The last token is EOF.
"""

from __future__ import annotations

import re

PY_WORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if "
    "import in is lambda nonlocal not or pass raise return try while with yield".split()
)
JS_WORDS = frozenset(
    "await break case catch class const continue debugger default delete do else enum export extends false finally for "
    "function if import in instanceof new null return super switch this throw true try typeof var void while with yield "
    "implements interface package private protected public static let".split()
)
#: Reserved in strict code only; TypeScript uses most of them as modifiers, and as property names they are plain words.
JS_SOFT = frozenset("implements interface package private protected public static let".split())

_PY = re.compile(
    r"""(?P<ws>[ \t\f]+|\\(?:\r\n|\r|\n))|(?P<nl>\r\n|\r|\n)|(?P<com>\#[^\r\n]*)
    |(?P<str>(?:[rR]?[bB]|[bB]?[rR]|[uU]|[fF][rR]?|[rR][fF])?(?:\"\"\"|'''|"|'))
    |(?P<num>(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?
       |[0-9](?:_?[0-9])*\.?(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?)(?!\w))
    |(?P<name>[^\W\d]\w*)
    |(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\*\*|//|>>|<<|<=|>=|==|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%@&|^~<>()\[\]{},:.;=])""",
    re.X,
)
_END = {q: re.compile(r"(?:[^\\%s\r\n]|\\(?:\r\n|.|\n))*%s" % (q, q), re.S) for q in "'\""} | {
    q * 3: re.compile(r"(?:[^\\%s]|\\.|%s{1,2}(?!%s))*%s{3}" % (q, q, q, q), re.S) for q in "'\""
}
_LEAD0 = re.compile(r"0[0-9_]*[1-9][0-9_]*\Z")


def _fstring_end(s: str, i: int, quote: str) -> int:
    """End of a formatted string whose text begins at i; replacement fields may hold strings and brackets. -1: none."""
    n, depth = len(s), 0
    while i < n:
        c = s[i]
        if depth == 0:
            if c == "\\":
                i += 2
                continue
            if s.startswith(quote, i):
                return i + len(quote)
            if c in "\r\n" and len(quote) == 1:
                return -1
            if c == "{":
                if s.startswith("{{", i):
                    i += 2
                    continue
                depth = 1
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c in "\"'":
            if s.startswith(quote, i) and depth == 1 and s.find("}", i) < 0:
                return -1
            q = c * 3 if s.startswith(c * 3, i) else c
            m = _END[q].match(s, i + len(q))
            if not m:
                return -1
            i = m.end()
            continue
        elif c in "\r\n" and len(quote) == 1 and depth == 0:
            return -1
        i += 1
    return -1


def lex_python(s: str, recover: bool = False, ends: list | None = None) -> tuple[list, list, list, list]:
    """``recover``: go on after a string that does not end. ``ends`` receives the end offset of every token."""
    T, V, P = [], [], []
    n, i, depth, line_start = len(s), 1 if s[:1] == "\ufeff" else 0, 0, True
    stack = [(0, 0)]
    match = _PY.match

    def add(kind, word, at):
        T.append(kind)
        V.append(word)
        P.append(at)

    while i < n:
        if ends is not None and len(ends) < len(T):
            ends.extend([i] * (len(T) - len(ends)))
        if line_start and depth == 0:
            col = alt = 0
            j = i
            while j < n and s[j] in " \t\f":
                if s[j] == "\t":
                    col, alt = (col // 8 + 1) * 8, alt + 1
                elif s[j] == "\f":
                    col = alt = 0
                else:
                    col, alt = col + 1, alt + 1
                j += 1
            if j < n and s[j] not in "#\r\n":
                if (col > stack[-1][0]) != (alt > stack[-1][1]) or (col == stack[-1][0]) != (alt == stack[-1][1]):
                    add("ERR", None, j)
                if col > stack[-1][0]:
                    stack.append((col, alt))
                    add("INDENT", None, j)
                else:
                    while col < stack[-1][0]:
                        stack.pop()
                        add("DEDENT", None, j)
                    if col != stack[-1][0]:
                        add("ERR", None, j)
            i, line_start = j, False
            if i >= n:
                break
        m = match(s, i)
        if not m:
            add("ERR", None, i)
            i += 1
            continue
        kind = m.lastgroup
        at, i = i, m.end()
        if kind == "ws" or kind == "com":
            continue
        if kind == "name":
            w = m.group()
            add(w if w in PY_WORDS else "NAME", w, at)
        elif kind == "op":
            w = m.group()
            if w in "([{":
                depth += 1
            elif w in ")]}":
                depth = max(0, depth - 1)
            add(w, None, at)
        elif kind == "nl":
            if depth == 0:
                if T and T[-1] not in ("NEWLINE", "INDENT", "DEDENT"):
                    add("NEWLINE", None, at)
                line_start = True
        elif kind == "num":
            add("ERR" if _LEAD0.match(m.group()) else "NUMBER", None, at)
        else:
            opening = m.group()
            q = opening[-3:] if opening[-3:] in ('"""', "'''") else opening[-1]
            if "f" in opening.lower():
                e = _fstring_end(s, i, q)
            else:
                x = _END[q].match(s, i)
                e = x.end() if x else -1
            if e < 0:
                add("ERR", "string", at)
                i = max(s.find("\n", i), i) if recover and "\n" in s[i:] else n
            else:
                add("STRING", None, at)
                i = e
    if ends is not None:
        ends.extend([n] * (len(T) + len(stack) + 2 - len(ends)))
    if T and T[-1] not in ("NEWLINE", "DEDENT", "ERR") and depth == 0:
        add("NEWLINE", None, n)
    if depth == 0:
        for _ in stack[1:]:
            add("DEDENT", None, n)
    add("EOF", None, n)
    return T, V, None, P


_JS = re.compile(
    r"""(?P<ws>[ \t\f\v\xa0﻿]+)|(?P<nl>\r\n|[\r\n  ])|(?P<com>//[^\r\n  ]*|/\*(?:[^*]|\*(?!/))*\*/)
    |(?P<name>(?:[^\W\d]|[$_])(?:\w|[$‌‍])*)
    |(?P<str>"(?:[^"\\\r\n]|\\(?:\r\n|.|\n))*"|'(?:[^'\\\r\n]|\\(?:\r\n|.|\n))*')
    |(?P<num>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:0|[1-9](?:_?[0-9])*)n|(?:(?:0|[1-9](?:_?[0-9])*)(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?)(?![\w$]))
    |(?P<priv>\#(?:[^\W\d]|[$_])(?:\w|\$)*)|(?P<hash>\#![^\r\n]*)
    |(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|\*\*|<<|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^~<>!?:=()\[\]{},.;@`])""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*")
_TPL = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_VALUE_END = frozenset(["NAME", "NUMBER", "STRING", ")", "]", "}", "TPL0", "TPLE", "this", "super", "null", "true", "false", "REGEX", "PRIV"])


def lex_js(s: str, recover: bool = False, ends: list | None = None) -> tuple[list, list, list, list]:
    T, V, NL, P = [], [], [], []
    n, i, nl = len(s), 1 if s[:1] == "\ufeff" else 0, False
    braces: list[bool] = []  # True: this brace closes a template substitution
    match = _JS.match

    def add(kind, word, at):
        T.append(kind)
        V.append(word)
        NL.append(nl)
        P.append(at)

    while i < n:
        if ends is not None and len(ends) < len(T):
            ends.append(i)
        m = match(s, i)
        if not m:
            add("ERR", "string" if s[i] in "\"'" else None, i)
            i += 1
            nl = False
            continue
        kind, at = m.lastgroup, i
        i = m.end()
        if kind == "ws":
            continue
        if kind == "nl":
            nl = True
            continue
        if kind == "com":
            nl = nl or "\n" in m.group()
            continue
        if kind == "name":
            w = m.group()
            add(w if w in JS_WORDS and w not in JS_SOFT else "NAME", w, at)
        elif kind == "op":
            w = m.group()
            if w == "/" or w == "/=":
                if not (T and T[-1] in _VALUE_END):
                    x = _REGEX.match(s, at)
                    if x:
                        add("REGEX", None, at)
                        i, nl = x.end(), False
                        continue
                if s.startswith("/*", at):
                    add("ERR", "comment", at)
                    i = at + 2 if recover else n
                    continue
            if w == "`" or (w == "}" and braces and braces[-1]):
                tail = w == "}"
                if tail:
                    braces.pop()
                i = _TPL.match(s, i).end()
                if i >= n:
                    add("ERR", "template", at)
                elif s[i] == "`":
                    add("TPLE" if tail else "TPL0", None, at)
                    i += 1
                else:
                    add("TPLM" if tail else "TPLS", None, at)
                    braces.append(True)
                    i += 2
            else:
                if w == "{":
                    braces.append(False)
                elif w == "}" and braces:
                    braces.pop()
                add(w, None, at)
        elif kind == "hash":
            if at == 0 or (at == 1 and s[0] == "\ufeff"):
                continue
            add("ERR", None, at)
        else:
            add({"str": "STRING", "num": "NUMBER", "priv": "PRIV"}[kind], None, at)
        nl = False
    nl = True
    if ends is not None:
        ends.extend([n] * (len(T) + 1 - len(ends)))
    add("EOF", None, n)
    return T, V, NL, P
