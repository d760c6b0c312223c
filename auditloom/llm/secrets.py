"""Problem 7: credentials embedded in source code and configuration.

1. Index: every literal that could be a credential (quoted strings, joined over ``+``; provider tokens, logins in
   URLs and headers, key blocks also outside quotes) is emitted with its surface text, kind and the strength of
   its context, once per row of the table, and written; then folded corpus-wide to one row per surface with the number
   of distinct owners (repositories). Folding is map-side, so a literal in a third of all rows costs one row per task.
2. Suppress: a literal shared by more than ``OWNER_SHARE`` of all repositories (``LEAST_OWNERS`` of them at least) is a
   placeholder. The bound is a share, so a key that is copied into some repositories of a large corpus stays a finding.
3. Confirm: of the rest those with a structured value (provider format, signed token, private key with a body,
   decodable login) or a random or password-like value under a credential's name. They are written once.
4. Re-scan: every row is searched for all confirmed surfaces with an Aho-Corasick automaton. Which of the surfaces
   could be in a row is found by a join: runs of letters and digits, alone or as neighbours, are hashed for rows and for
   surfaces, and a surface can only be where its longest one is. So the work grows with the corpus, not with corpus times
   secrets, and no automaton holds more than the surfaces of one batch. The few surfaces without such a run go
   through all rows in blocks, each a written pass of its own.

Redaction replaces the value only (the password of a login, the token of a header), by a placeholder without
quotes, escapes or line ends lost, so the code around stays as it is and valid.

Defined cases: null content has no credentials; a null repo counts as one owner; the same secret in several
rows is found in each, as a whole word (not inside a longer run of letters and digits); overlapping occurrences: the
longest that begins first wins; empty tables give empty results; literals and texts of any length are read whole; a value of
less than five characters, or a password of lower-case letters only, is not taken for a usable credential; rows with
equal or null chunk_id are searched each by itself; extra columns are kept by ``redact`` only as named.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.session import written

OWNER_SHARE, LEAST_OWNERS = 0.01, 5
BLOCK_BYTES = 16 << 20

# Prefixes and lengths by which providers mark their credentials.
PROVIDER = re.compile(
    r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,}|xox[abposr]-[A-Za-z0-9\-]{10,}"
    r"|sk-(?:proj-|live-|ant-)?[A-Za-z0-9_\-]{20,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|[a-z]{2,8}_live_[A-Za-z0-9]{16,}|(?:AKIA|ASIA)[A-Z0-9]{16}|AIza[A-Za-z0-9_\-]{35}|npm_[A-Za-z0-9]{36}"
    r"|hf_[A-Za-z0-9]{30,}|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,})(?![A-Za-z0-9_])"
)
JWT = re.compile(r"(?<![A-Za-z0-9_])eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(.*?)-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|([A-Za-z0-9+/=\s]{20,})\Z)", re.S)
URL_LOGIN = re.compile(r"(?<![A-Za-z0-9+.\-])[A-Za-z][A-Za-z0-9+.\-]*://([^\s:/@\"'`<>]*):([^\s/@\"'`<>]+)@(?=[A-Za-z0-9\[])")
URL_PARAM = re.compile(r"[?&](?:api[_-]?key|key|token|access[_-]?token|auth|secret|client_secret|password|pwd|sig|signature)=([A-Za-z0-9_\-.~%+/=]{8,})", re.I)
HEADER = re.compile(r"\b(Basic|Bearer|Token)\s+([A-Za-z0-9+/_\-.=~]{12,})")
QUOTED = re.compile(r"\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
UNQUOTED = re.compile(r"(?<![\w.\-])([A-Za-z_][\w.\-]*)\s*[:=]\s*([^\s\"'`,;(){}\[\]<>$]{5,})\s*(?:[,;#]|$)", re.M)
CREDENTIAL = re.compile(
    r"pass(?:word|wd|phrase|wort|code)?(?![a-z])|passw|passphrase|pwd|(?:^|[_\-.])pw(?![a-z])|secret|token|api[_\-]?key|access[_\-]?key|auth[_\-]?key|authkey|private[_\-]?key|signing|hmac|cred|auth|pem|(?:^|[_\-.])key\d*$|passphrase|bearer|session_secret|webhook|dsn",
    re.I,
)
NO_CREDENTIAL = re.compile(
    r"sha\d*|checksum|digest|commit|revision|(?:^|[_\-.])rev\d*(?:$|[_\-.])|integrity|fingerprint|hash|etag|uuid|(?:^|[_\-.])id\d*$|request_id|public|pub(?:$|[_\-.])|_field|_env|label|_url$|max_tokens|blob|n_tokens|tokeni[sz]er|_count|_name$|_path|_file|_type",
    re.I,
)
PASSWORD_NAME = re.compile(r"pass(?:word|wd|phrase|wort|code)?(?![a-z])|pwd|secret", re.I)
PLACEHOLDER = re.compile(
    r"x{4,}|X{4,}|\*{3,}|\.{3,}|^[<\[{(].*[>\]})]$|\$\{|\{\{|\$\(|^\$[A-Za-z_]|%\(|^%[sd]|\{\w*\}|change[_\-]?(?:me|it)|your[_\-]|replace[_\-]?(?:me|with)|placeholder|example|dummy|sample|redacted|masked|from[_\-]env|todo|fixme|not[_\-]?a[_\-]?(?:real|secret)|fake|insert[_\-]|0{8,}|1234567|abcdefg|foobar|test[_\-]?(?:key|token|secret|password)",
    re.I,
)
_LINE = re.compile(r"[^\n]+")
_WORDS = ("key", "token", "pass", "secret", "pw", "auth", "cred", "signing", "hmac", "pem", "bearer", "webhook", "dsn")  # one is in every name that CREDENTIAL accepts
_MARKS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "sk-", "sk_", "rk_", "_live_", "AKIA", "ASIA", "AIza", "npm_", "hf_", "SG.")  # in every token that PROVIDER accepts
_SIMPLE = re.compile(r"\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\.)*'|`(?:[^`\\\r\n]|\\.)*`")
_ESC = re.compile(r"\\u([0-9a-fA-F]{4})")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _random(v: str) -> bool:
    """A value as a generator makes them: long, without blanks, letters and digits mixed, no path or dotted name."""
    if len(v) < 16 or not re.fullmatch(r"[A-Za-z0-9+/=_\-.~]+", v) or not re.search(r"\d", v) or not re.search(r"[A-Za-z]", v):
        return False
    if re.fullmatch(r"[A-Z][A-Z0-9_]*|[a-z]+(?:[_\-.][a-z0-9]+)*", v) and not re.fullmatch(r"[0-9a-f]{16,}", v):
        return False
    if re.search(r"\.(?:py|js|ts|json|toml|ya?ml|md|txt|html?|com|org|net|example|test|invalid)\b", v) or re.fullmatch(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", v):
        return False
    return entropy(v) >= (2.8 if re.fullmatch(r"[0-9a-fA-F]+", v) else 3.2)


def _password(v: str) -> bool:
    """A chosen secret: one word of letters with digits, mixed in case or with a sign; without a digit, mixed in case and with a sign."""
    if len(v) < 5 or re.search(r"[\s/\\<>{}()]", v) or not re.search(r"[A-Za-z]", v):
        return False
    if re.fullmatch(r"[A-Z][A-Z0-9_]*|v?\d+(?:\.\d+)+\S*|[a-z]+(?:[_\-.][a-z0-9]+)*\d*|\d{4}-\d\d-\d\d.*", v):
        return False
    mixed = bool(re.search(r"[a-z]", v) and re.search(r"[A-Z]", v))
    if not re.search(r"\d", v):
        return mixed and len(v) >= 8 and bool(re.search(r"[!#%&*+=?@^~|$]", v))
    return mixed or bool(re.search(r"[^A-Za-z0-9]", v))


def _plain(v: str) -> bool:
    return not PLACEHOLDER.search(v) and max(Counter(v).values()) <= 0.5 * len(v)


def _basic(v: str) -> bool:
    try:
        text = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return False
    user, sep, secret = text.partition(":")
    return bool(sep and secret and text.isprintable() and _plain(text))


def candidates(text: str) -> list[tuple[str, str, str, bool]]:
    """(surface, kind, value, confirmed by its own structure and context) of every literal that could be a credential.

    The surface is the exact text of the value part, so a scan for it finds the place to redact."""
    out: list[tuple[str, str, str, bool]] = []
    taken: list[tuple[int, int]] = []

    def add(a, b, kind, value, ok):
        out.append((text[a:b], kind, value, ok))
        taken.append((a, b))

    if "PRIVATE KEY" in text:
        for m in PEM.finditer(text):
            body = re.sub(r"\\[nrt]|[^A-Za-z0-9+/=]", "", m.group(1) or m.group(2))  # the second where a row ends inside the key
            add(m.start(), m.end(), "private_key", body, len(body) >= (40 if m.group(1) else 20) and _plain(body) and entropy(body) > 3.5)
    if "://" in text:
        for m in URL_LOGIN.finditer(text):
            v = m.group(2)
            ok = len(v) >= 4 and _plain(v) and not re.fullmatch(r"(?i)pass(?:word)?|pw|secret|user|admin|token|key", v) and "$" not in v[:1]
            add(*(m.span(2) if len(v) >= 8 else (m.start(1), m.end())), "url_login", v, ok)
        for m in URL_PARAM.finditer(text):
            add(*m.span(1), "url_parameter", m.group(1), _plain(m.group(1)) and (_random(m.group(1)) or (len(m.group(1)) >= 16 and entropy(m.group(1)) > 3)))
    _quoted(text, list(QUOTED.finditer(text)), taken, add)
    # once more line by line: literals in comments, inside longer literals and after an unpaired quote
    for m in _LINE.finditer(text):
        line = m.group()
        if "Basic " in line or "Bearer " in line or (_named(line) and CREDENTIAL.search(line)):
            _quoted(text, list(_SIMPLE.finditer(text, m.start(), m.end())), taken, add)
    taken.sort()
    for rx, kind, marks in ((PROVIDER, "token", _MARKS), (JWT, "token", ("eyJ",))):
        for m in rx.finditer(text) if any(x in text for x in marks) else ():
            if not any(x < m.end() and m.start() < y for x, y in taken):
                add(m.start(), m.end(), kind, m.group(), _plain(m.group()[4:]) and entropy(m.group()) > 3.0)
    for m in HEADER.finditer(text) if any(x in text for x in ("Basic", "Bearer", "Token")) else ():
        if not any(x < m.end() and m.start() < y for x, y in taken):
            v = m.group(2)
            if m.group(1) == "Basic" and _basic(v) or m.group(1) == "Bearer" and JWT.search(v):
                add(*m.span(2), "header", v, _plain(v))
    for m in UNQUOTED.finditer(text):
        if _named(m.group(1)) and CREDENTIAL.search(m.group(1)) and not NO_CREDENTIAL.search(m.group(1)) and not any(x < m.end() and m.start() < y for x, y in taken):
            v = m.group(2)
            if re.search(r"\w\.\w|\w\(", v) or (len(v) < 8 and not PASSWORD_NAME.search(m.group(1))):
                continue
            if re.search(r"[^\w\-.]", v) and _password(v) or _random(v) and re.search(r"[A-Z]", v) and re.search(r"[a-z]", v) and re.search(r"\d.*\D.*\d", v):
                add(*m.span(2), "password" if _password(v) else "key", v, _plain(v))
    return [c for c in out if len(c[0]) >= 5]


_NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$.-")
_TYPE_CHARS = _NAME_CHARS | frozenset("[]<>| ")


def _back(text: str, at: int, chars) -> int:
    while at > 0 and text[at - 1] in chars:
        at -= 1
    return at


def names_before(text: str, at: int) -> list[str]:
    """Names that the literal at ``at`` is given to: by assignment (also with a type, in parentheses, or as a key), or as the default of a
    look-up. Read backwards token by token, however far the name is."""
    i = at
    if i > 0 and text[i - 1] in "rRbBfFuU":  # prefix of a Python string
        k = _back(text, i, frozenset("rRbBfFuU"))
        if i - k <= 2 and (k == 0 or text[k - 1] not in _NAME_CHARS):
            i = k
    while i > 0 and (text[i - 1].isspace() or text[i - 1] == "("):
        i -= 1
    op = text[i - 1 : i]
    if op == ">" and text[i - 2 : i] == "=>":
        i -= 2
    elif op == "=":
        if text[i - 2 : i - 1] in ("=", "!", "<", ">"):
            return []
        i -= 3 if text[i - 3 : i - 1] in ("??", "||") else 2 if text[i - 2 : i - 1] == ":" else 1
    elif op in (":", ","):
        i -= 1
    else:
        return []
    while i > 0 and text[i - 1].isspace():
        i -= 1
    end = i
    while i > 0 and text[i - 1] in "\"' \t]":
        i -= 1
    k = _back(text, i, _NAME_CHARS)
    names = [text[k:i]] if i > k else []
    if op == ",":
        j = k
        while j > 0 and (text[j - 1] in "\"'" or text[j - 1].isspace()):
            j -= 1
        call = text[_back(text, j - 1, _NAME_CHARS) : j - 1] if text[j - 1 : j] == "(" else ""
        return names if re.search(r"(?:setdefault|getenv|get|environ)\w*\Z", call) else []
    if op == "=":  # name: type = literal
        j = _back(text, end, _TYPE_CHARS)
        if text[j - 1 : j] == ":":
            j -= 1
            while j > 0 and (text[j - 1].isspace() or text[j - 1] == "?"):
                j -= 1
            names.append(text[_back(text, j, _NAME_CHARS) : j])
    return [re.sub(r"\A[.\-\d]+", "", n) for n in names]


def _named(line: str) -> bool:
    low = line.lower()
    for w in _WORDS:
        if w in low:
            return True
    return False


def _quoted(text, quoted, taken, add):
    """Quoted literals, joined over +, judged by their format and by the name that they are given to."""
    k = 0
    while k < len(quoted):
        m = quoted[k]
        q = 3 if text[m.start() : m.start() + 3] in ('\"\"\"', "'''") else 1
        a, b = m.start() + q, m.end() - q
        parts, last = [text[a:b]], k
        while last + 1 < len(quoted) and _PLUS.fullmatch(text, quoted[last].end(), quoted[last + 1].start()):
            last += 1
            parts.append(quoted[last].group()[1:-1])
            b = quoted[last].end() - 1
        k = last + 1
        value = "".join(parts)
        if len(value) < 5 or any(x < b and a < y for x, y in taken):
            continue
        value = _ESC.sub(lambda m: chr(int(m.group(1), 16)), value)
        h = HEADER.fullmatch(value)
        if h:
            v = h.group(2)
            lead = a + len(text[a:b]) - len(re.sub(r"\A(?:Basic|Bearer|Token)\s+", "", text[a:b]))
            add(lead, b, "header", v, _plain(v) and (_basic(v) if h.group(1) == "Basic" else bool(JWT.search(v) or PROVIDER.search(v)) or _random(v)))
            continue
        p = PROVIDER.fullmatch(value) or JWT.fullmatch(value)
        if p:
            add(a, b, "token", value, _plain(value[4:]) and entropy(value) > 3.0)
            continue
        if not (_password(value) or _random(value)):
            continue
        names = names_before(text, m.start())
        if any(CREDENTIAL.search(n) and not NO_CREDENTIAL.search(n) for n in names):
            if _password(value) and not re.fullmatch(r"[0-9a-f]+|[A-Za-z0-9+/=]{32,}", value):
                if len(value) >= 8 or any(PASSWORD_NAME.search(n) for n in names):
                    add(a, b, "password", value, _plain(value))
            elif _random(value):
                add(a, b, "key", value, _plain(value))


_PLUS = re.compile(r"\s*\+\s*")
_CANDIDATE = T.ArrayType(T.StructType([T.StructField("surface", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("strong", T.BooleanType())]))


@F.pandas_udf(_CANDIDATE)
def _candidates(content: pd.Series) -> pd.Series:
    return pd.Series([list({(s, k, ok) for s, k, _, ok in candidates(c)}) if c else [] for c in content])


def literals(chunks: DataFrame) -> DataFrame:
    """repo, surface, kind and strong of every literal of every row; the one pass of extraction, written."""
    found = chunks.select(F.coalesce("repo", F.lit("")).alias("repo"), F.explode(_candidates("content")).alias("c")).select("repo", "c.*")
    return written(found, "literals")


def literal_index(found: DataFrame) -> DataFrame:
    """One row per literal: surface, kind, strong (confirmed in some context), owners (distinct repositories)."""
    per_owner = found.groupBy("surface", "repo").agg(F.max("strong").alias("strong"), F.min("kind").alias("kind"))
    return per_owner.groupBy("surface").agg(F.min("kind").alias("kind"), F.max("strong").alias("strong"), F.count(F.lit(1)).alias("owners"))


def confirmed(chunks: DataFrame, owner_share: float = OWNER_SHARE, least_owners: int = LEAST_OWNERS) -> DataFrame:
    """surface, kind and owners of the confirmed credentials, written; the number of repositories joins as one row."""
    bound = chunks.agg(F.greatest(F.lit(least_owners), F.ceil(F.approx_count_distinct("repo") * F.lit(owner_share))).alias("bound"))
    index = literal_index(literals(chunks)).where("strong").crossJoin(F.broadcast(bound)).where("owners < bound")
    return written(index.select("surface", "kind", "owners"), "secrets")


_HIT = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


# a run that holds a digit (or is long), such a run with the next one, and a run of letters with the next one that holds a digit
_GRAMS = (
    r"((?<![A-Za-z0-9])(?=[A-Za-z0-9]{4})[A-Za-z]*[0-9][A-Za-z0-9]*|(?<![A-Za-z0-9])[A-Za-z]{20,}(?![0-9]))",
    r"(?<![A-Za-z0-9])(?=([A-Za-z]*[0-9][A-Za-z0-9]*[^A-Za-z0-9]+[A-Za-z0-9]+))",
    r"(?<![A-Za-z0-9])(?=([A-Za-z]+[^A-Za-z0-9]+[A-Za-z]*[0-9][A-Za-z0-9]*))",
)


def grams(text):
    """Runs of letters and digits, and neighbouring ones with what is between them, that tell a credential: each holds a digit or is long. A surface
    that occurs as a whole word has its grams in common with the text around it."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(g), F.lit(1)) for g in _GRAMS]))


def _anchored(secrets: DataFrame) -> DataFrame:
    """surface, kind, h: hash of the surface's longest gram; null where it has none."""
    longest = F.array_max(F.transform(grams(F.col("surface")), lambda g: F.struct(F.length(g).alias("n"), g.alias("g"))))
    return secrets.select("surface", "kind", F.when(longest.isNotNull(), F.xxhash64(longest["g"])).alias("h"))


def scan(chunks: DataFrame, secrets: DataFrame, keep: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns, content and hits (start, end, kind) of every row, hits not overlapping.

    Rows are told apart by a hash of chunk_id and content: equal rows have equal hits."""
    anchored = _anchored(secrets)
    rows = chunks.select(*keep, "content", F.xxhash64("chunk_id", "content").alias("row"))
    runs = rows.select("row", F.explode(grams(F.col("content"))).alias("g")).select("row", F.xxhash64("g").alias("h"))
    near = runs.join(anchored.where("h IS NOT NULL"), "h").groupBy("row").agg(F.collect_set(F.struct("surface", "kind")).alias("near"))
    out = rows.join(near, "row", "left").select(*keep, "content", F.when(F.col("near").isNull(), F.array().cast(_HIT)).otherwise(_search("content", "near")).alias("hits"))
    for block in _blocks(anchored.where("h IS NULL"), block_bytes):
        shared = chunks.sparkSession.sparkContext.broadcast(block)
        out = written(out.withColumn("hits", F.concat("hits", F.pandas_udf(_finder(shared), _HIT)("content"))), "scanned")
    return out


def _blocks(rest: DataFrame, block_bytes: int) -> Iterator[dict[str, str]]:
    """Surfaces in blocks of about ``block_bytes``, each small enough for the driver and a broadcast."""
    size = rest.agg(F.sum(F.octet_length("surface") + 64)).first()[0] or 0
    n = math.ceil(size / block_bytes)
    for b in range(n):
        part = rest if n == 1 else rest.where(F.pmod(F.xxhash64("surface"), F.lit(n)) == b)
        block = {r.surface: r.kind for r in part.select("surface", "kind").toLocalIterator()}
        if block:
            yield block


def _automaton(surfaces: dict[str, str]):
    automaton = ahocorasick.Automaton()
    for surface, kind in surfaces.items():
        automaton.add_word(surface, (len(surface), kind))
    automaton.make_automaton()
    return automaton


_WORD_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def _hits(automaton, text: str) -> list[tuple[int, int, str]]:
    """Occurrences as whole words."""
    out, n = [], len(text)
    for last, (length, kind) in automaton.iter(text):
        a, b = last + 1 - length, last + 1
        if not (a > 0 and text[a] in _WORD_CHARS and text[a - 1] in _WORD_CHARS) and not (b < n and text[last] in _WORD_CHARS and text[b] in _WORD_CHARS):
            out.append((a, b, kind))
    return out


@F.pandas_udf(_HIT)
def _search(content: pd.Series, near: pd.Series) -> pd.Series:
    """One automaton per batch, of the surfaces that its rows may hold."""
    surfaces = {s["surface"]: s["kind"] for group in near if group is not None for s in group}
    if not surfaces:
        return pd.Series([[] for _ in content])
    automaton = _automaton(surfaces)
    return pd.Series([_hits(automaton, c) if c and group is not None else [] for c, group in zip(content, near)])


def _finder(shared):
    """A scan of texts for one broadcast block; each task builds the automaton once."""

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(shared.value)
        for content in batches:
            yield pd.Series([_hits(automaton, c) if c else [] for c in content])

    find.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return find


def _without_overlap(hits) -> list:
    out, at = [], -1
    for h in sorted(hits, key=lambda h: (h["start"], -h["end"])):
        if h["start"] >= at:
            out.append(h)
            at = h["end"]
    return out


_LINES = T.ArrayType(T.StructType([T.StructField("line_no", T.LongType()), T.StructField("kind", T.StringType())]))


@F.pandas_udf(_LINES)
def _lines(content: pd.Series, hits: pd.Series) -> pd.Series:
    return pd.Series([[(c.count("\n", 0, h["start"]) + 1, h["kind"]) for h in _without_overlap(hs)] for c, hs in zip(content, hits)])


@F.pandas_udf(T.StringType())
def _redacted(content: pd.Series, hits: pd.Series) -> pd.Series:
    out = []
    for c, hs in zip(content, hits):
        if c is None or len(hs) == 0:
            out.append(c)
            continue
        parts, at = [], 0
        for h in _without_overlap(hs):
            gone = c[h["start"] : h["end"]]
            parts += [c[at : h["start"]], f"REDACTED_{h['kind'].upper()}"]
            joined = re.search(r"([\"'`])\s*\+\s*\1", gone)
            if not joined:
                parts.append("\n" * gone.count("\n"))
            at = h["end"]
        out.append("".join(parts) + c[at:])
    return pd.Series(out)


def secret_lines(chunks: DataFrame) -> DataFrame:
    """chunk_id and line_no (split at line feeds, from 1) where a credential begins."""
    hits = scan(chunks, confirmed(chunks), ["chunk_id"]).where(F.size("hits") > 0)
    return hits.select("chunk_id", F.explode(_lines("content", "hits")).alias("l")).select("chunk_id", "l.line_no").distinct()


def redact(chunks: DataFrame) -> DataFrame:
    """chunk_id, repo, file_path, content with placeholders, and the number of credentials, of every row."""
    rows = scan(chunks, confirmed(chunks), ["chunk_id", "repo", "file_path"])
    return rows.select("chunk_id", "repo", "file_path", _redacted("content", "hits").alias("content"), F.size(F.coalesce("hits", F.array())).alias("n_hits"))
