"""Packrat parsing-expression grammars, compiled from text to Python functions.

A grammar is text: ``rule <- expression``. Expressions know sequences, ordered choice ``/``, ``* + ?``,
predicates ``& !``, groups, token kinds (``NAME``), reserved words and punctuation (``'if'``), contextual
words (``"from"``), regular expressions over characters (``~'...'``) and the predicates ``%word`` (any
word), ``%nl`` / ``%nonl`` (a line end does or does not precede the token) and ``%never``. Every rule
written with ``<-`` is memoised by position, which makes parsing linear; ``<~`` marks a rule too small to be
worth a memo. Token grammars get FIRST sets, by which ordered choice skips alternatives that cannot match.

Two versions are compiled: a plain one, and one that also records the furthest failure, used only for input
that the plain one rejected.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"""\s*(~'(?:[^'\\]|\\.)*'|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|%\w+|[A-Za-z_]\w*|[()/?*+&!])""")
_RULE = re.compile(r"^(\w+) (<-|<~)(.*?)(?=^\w+ <[-~]|\Z)", re.M | re.S)
ANY = None  # FIRST set of an expression that may begin with anything


def _read(text: str) -> dict[str, tuple[bool, tuple]]:
    rules = {}
    for name, arrow, body in _RULE.findall(text):
        toks, at = [], 0
        while body[at:].strip():
            m = _TOKEN.match(body, at)
            if not m:
                raise ValueError(f"grammar rule {name}: {body[at:at + 20]}")
            toks.append(m.group(1))
            at = m.end()
        node, rest = _choice(toks, 0)
        if rest != len(toks):
            raise ValueError(f"grammar rule {name} at {toks[rest:][:4]}")
        rules[name] = (arrow == "<-", node)
    return rules


def _choice(t, i):
    alts = []
    while True:
        node, i = _seq(t, i)
        alts.append(node)
        if i < len(t) and t[i] == "/":
            i += 1
        else:
            return (alts[0] if len(alts) == 1 else ("alt", alts)), i


def _seq(t, i):
    parts = []
    while i < len(t) and t[i] not in "/)":
        prefix = t[i] if t[i] in "&!" else None
        i += prefix is not None
        if t[i] == "(":
            node, i = _choice(t, i + 1)
            i += 1
        else:
            tok = t[i]
            i += 1
            node = ("rx", tok[2:-1]) if tok[0] == "~" else ("ctx", tok[1:-1]) if tok[0] == '"' else ("lit", tok[1:-1]) if tok[0] == "'" else ("pred", tok[1:]) if tok[0] == "%" else ("kind", tok) if tok.isupper() else ("rule", tok)
        while i < len(t) and t[i] in "?*+":
            node = ({"?": "opt", "*": "star", "+": "plus"}[t[i]], node)
            i += 1
        parts.append(({"&": "and", "!": "not"}[prefix], node) if prefix else node)
    return (parts[0] if len(parts) == 1 else ("seq", parts)), i


class Grammar:
    """``parse(T, V, NL)`` for token grammars, ``parse(text)`` for grammars over characters: None if the
    whole input matches, else (position, expected terminals) of the furthest failure."""

    def __init__(self, text: str, start: str = "file", chars: bool = False, words: frozenset[str] = frozenset()):
        self.rules, self.start, self.chars, self.words = _read(text), start, chars, words
        self._first: dict[str, tuple] = {}
        if not chars:
            self._find_first()
        self._plain, self._tracking = self._compile(False), self._compile(True)

    # FIRST sets: (set or ANY, nullable)
    def _find_first(self):
        self._first = {n: (frozenset(), False) for n in self.rules}
        changed = True
        while changed:
            changed = False
            for n, (_, node) in self.rules.items():
                new = self._f(node)
                if new != self._first[n]:
                    self._first[n], changed = new, True

    def _f(self, node):
        op, x = node
        if op in ("lit", "kind"):
            return frozenset([x]), False
        if op == "ctx":
            return frozenset(["NAME"]), False
        if op == "pred":
            return (self.words | {"NAME"}, False) if x == "word" else (frozenset(), x != "never")
        if op == "rule":
            return self._first[x]
        if op in ("opt", "star"):
            return self._f(x)[0], True
        if op == "plus":
            return self._f(x)
        if op in ("and", "not"):
            return frozenset(), True
        if op == "alt":
            fs = [self._f(y) for y in x]
            return frozenset().union(*(f for f, _ in fs)), any(e for _, e in fs)
        out = frozenset()
        for y in x:
            f, e = self._f(y)
            out |= f
            if not e:
                return out, False
        return out, True

    def _compile(self, track: bool):
        self._n, self._consts, self._ids = 0, {}, {}
        lines = ["def make(S):" if self.chars else "def make(T, V, NL):"]
        if track:
            lines.append(" far = [-1, set()]")
            lines.append(" def miss(p, x):\n  if p > far[0]: far[0] = p; far[1] = {x}\n  elif p == far[0]: far[1].add(x)\n  return -1")
        for name, (memo, node) in self.rules.items():
            if memo:
                lines.append(f" M_{name} = {{}}")
            lines.append(f" def r_{name}(p):")
            if memo:
                lines.append(f"  m = M_{name}.get(p)\n  if m is not None: return m\n  p0 = p")
            self._emit(node, 2, lines, track)
            if memo:
                lines.append(f"  M_{name}[p0] = p")
            lines.append("  return p")
        lines.append(f" return r_{self.start}, {'far' if track else 'None'}")
        env = dict(self._consts)
        exec(compile("\n".join(lines), f"<grammar {self.start}>", "exec"), env)
        return env["make"]

    def _const(self, value, prefix):
        if (prefix, value) not in self._ids:
            self._ids[(prefix, value)] = f"{prefix}{len(self._ids)}"
            self._consts[self._ids[(prefix, value)]] = re.compile(value, re.S).match if prefix == "RX" else value
        return self._ids[(prefix, value)]

    def _tmp(self):
        self._n += 1
        return f"s{self._n}"

    def _emit(self, node, d, out, track):
        op, x = node
        pad = " " * d
        miss = (lambda label: f"miss(p, {label!r})") if track else (lambda label: "-1")
        if op == "rx":
            out.append(f"{pad}m = {self._const(x, 'RX')}(S, p)\n{pad}p = m.end() if m else {miss(x)}")
        elif op == "lit" and self.chars:
            out.append(f"{pad}p = p + {len(x)} if S.startswith({x!r}, p) else {miss(x)}")
        elif op in ("lit", "kind"):
            out.append(f"{pad}p = p + 1 if T[p] == {x!r} else {miss(x)}")
        elif op == "ctx":
            out.append(f"{pad}p = p + 1 if V[p] == {x!r} else {miss(x)}")
        elif op == "pred":
            if x == "word":
                out.append(f"{pad}p = p + 1 if V[p] is not None else {miss('word')}")
            elif x == "never":
                out.append(f"{pad}p = -1")
            else:
                out.append(f"{pad}p = p if {'' if x == 'nl' else 'not '}NL[p] else {miss(x)}")
        elif op == "rule":
            out.append(f"{pad}p = r_{x}(p)")
        elif op == "seq":
            for k, y in enumerate(x):
                if k:
                    out.append(f"{' ' * d}if p >= 0:")
                    d += 1
                self._emit(y, d, out, track)
        elif op == "alt":
            s = self._tmp()
            out.append(f"{pad}{s} = p")
            for k, y in enumerate(x):
                dd = d
                if k:
                    out.append(f"{pad}if p < 0:\n{pad} p = {s}")
                    dd = d + 1
                f, empty = (ANY, True) if self.chars else self._f(y)
                if track or empty or y[0] in ("lit", "kind", "ctx"):
                    self._emit(y, dd, out, track)
                else:
                    test = f"T[p] == {next(iter(f))!r}" if len(f) == 1 else f"T[p] in {self._const(f, 'F')}"
                    out.append(f"{' ' * dd}if {test}:")
                    self._emit(y, dd + 1, out, track)
                    out.append(f"{' ' * dd}else: p = -1")
        elif op == "opt":
            s = self._tmp()
            out.append(f"{pad}{s} = p")
            self._emit(x, d, out, track)
            out.append(f"{pad}if p < 0: p = {s}")
        elif op in ("star", "plus"):
            s = self._tmp()
            if op == "plus":
                self._emit(x, d, out, track)
                out.append(f"{pad}if p >= 0:")
                d, pad = d + 1, pad + " "
            out.append(f"{pad}while True:\n{pad} {s} = p")
            self._emit(x, d + 1, out, track)
            out.append(f"{pad} if p < 0 or p == {s}:\n{pad}  p = {s}\n{pad}  break")
        else:
            s = self._tmp()
            out.append(f"{pad}{s} = p")
            self._emit(x, d, out, track)
            out.append(f"{pad}if p >= 0: p = {s}" if op == "and" else f"{pad}p = {s} if p < 0 else -1")

    def accepts(self, *args) -> bool:
        return self._plain(*args)[0](0) >= 0

    def parse(self, *args):
        rule, _ = self._plain(*args)
        if rule(0) >= 0:
            return None
        rule, far = self._tracking(*args)
        rule(0)
        return max(far[0], 0), sorted(far[1])[:8]
