"""Problem 10: text statistics per document, and natural prose told from lists, tables and junk.

``statistics`` gives the plain figures per document with built-in expressions. For the kinds, a document is cut
into blocks of lines with the same layout; standardised statistics of the blocks are fitted with a Gaussian
mixture by expectation-maximisation over all blocks of the corpus: each step is one pass in which tasks fold
their blocks to sufficient statistics per component, so only components x statistics numbers are gathered. The mixture
starts from blocks of the corpus itself (k-means++ on a sample of at most about ``SAMPLE`` blocks, drawn by hash) and runs until
the likelihood of a block grows by less than ``TOLERANCE``. Only then inspected examples name the components: each takes the
kinds of the ``NEAREST`` examples to its mean. A document's kind is that which has the most of its characters.

Defined cases: null, empty and blank texts have no blocks and are no finding (their statistics are 0); ties
between kinds go to prose, then list, table, junk; repeated documents are cases of their own; a single very long
line is one block; fewer different blocks than components give as many components; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.session import written

KINDS = ("prose", "list", "table", "junk")
COMPONENTS, SAMPLE, NEAREST = 96, 20_000, 5
TOLERANCE, EM_STEPS = 1e-3, 100  # gain in log-likelihood per block at which the fit ends; steps after which it ends anyhow
FLOOR = 0.05  # least variance of a standardised statistic

# The most frequent function words of English, German, Spanish and French.
COMMON = frozenset(
    "the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they you were there one all we can her has "
    "more if no when what so will would who do out up into them than its only some could these two may then other any new our most too after such where over before until once why both each neither nor whoever please without "
    "der die das und ist nicht zu den von mit sich des auf für im dem ein eine als auch es an er hat aus bei nach wird sie nur noch wer wir haben dass sollte vorher oder wenn solange sobald weil immer erst "
    "el la los las de que y en un una por con no es se del al lo su para más como ha este si ya o pero porque cuando también antes después hemos visto siempre quien hace falta bien "
    "le les des et à un une est dans qui que pas pour par sur au il ce ne se plus avec sont du ou mais cette son aussi avant quand pour nous avons vu toujours faut parler en"
    .split()
)

_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_TOKEN = re.compile(r"\S+")
_CLEAN = re.compile(r"[(\"'“«¿¡*_]*[^\W\d_]+(?:['’\-][^\W\d_]+)*[)\"'”»*_]*[.,;:!?…]*\Z")
_MARK = re.compile(r"\s*(?:[-*•‣▪◦·+–]\s|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)]\s|\[[ xX]?\]\s)")
_LEADER = re.compile(r"\.{4,}|…{2,}|(?:\. ){3,}|_{4,}")
_GAPS = re.compile(r"(?<=\S) {2,}(?=\S)")
_VOWELS = re.compile(r"[aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿ]", re.I)
_STOP = re.compile(r"[.!?:;…。！？][)\"'”’»*`]*\Z")
_SPLIT = {"|": re.compile(r"\|"), "\t": re.compile(r"\t"), ",": re.compile(r","), ";": re.compile(r";"), "  ": re.compile(r"(?<=\S)\s{2,}(?=\S)"), "<td": re.compile(r"<t[dhr]", re.I), "&": re.compile(r" & ")}


def layout(line: str) -> tuple:
    """What kind of line it is to look at: marker, delimiter, and whether it is a short entry without a stop."""
    s = line.strip()
    words = len(s.split())
    if _MARK.match(line):
        return ("mark",)
    if "\t" in line or s.count("|") >= 2 or re.search(r"<t[drha]|</t", s, re.I) or re.match(r"\+[-=+]+\+|\|?[-:| ]{5,}\Z", s):
        return ("cells",)
    if _LEADER.search(s):
        return ("leader",)
    commas, semis = s.count(","), s.count(";")
    if max(commas, semis) >= 2 and (s.count(", ") + s.count("; ")) * 2 < commas + semis:
        return ("values",)
    if len(re.findall(r"(?<=\S) {2,}(?=\S)", s)) >= 2 or (re.search(r"\S {3,}\S", s) and words <= 12):
        return ("columns",)
    if re.match(r"#{1,6} \w", s) and words <= 10:
        return ("heading",)
    entries = re.split(r"[,;] ", s)
    if len(entries) >= 5 and words / len(entries) <= 3.6:
        return ("inline",)
    if words <= 6 and not _STOP.search(s):
        return ("short",)
    if words and len(s) / words > 12:
        return ("dense",)
    return ("text",)


def blocks(text: str) -> list[list[str]]:
    """Runs of lines with one layout; a blank line ends a run of text, not of entries or cells."""
    out: list[list[str]] = []
    last = None
    for line in text.splitlines():
        line = line.replace("\xa0", " ")
        gaps = _GAPS.findall(line)
        if len(gaps) >= 4 and sum(len(g) == 2 for g in gaps) >= 0.9 * len(gaps) and len(gaps) > 0.2 * len(line.split()):
            line = re.sub(" {2,}", " ", line)  # double spacing is a way to write, columns differ in width
        if not line.strip():
            if last in (("text",), ("heading",)):
                last = None
            continue
        k = layout(line)
        # a wrapped sentence may end in a short line
        if k == ("short",) and last == ("text",) and not _STOP.search(out[-1][-1].strip()) and len(out[-1][-1].split()) > 4:
            k = last
        if k == last:
            out[-1].append(line)
        else:
            out.append([line])
            last = k
    return out


def is_title(lines: list[str]) -> bool:
    """Headings and single short lines name what follows; they are no part of the text's kind."""
    k = layout(lines[0])
    return k == ("heading",) or (k == ("short",) and len(lines) == 1 and len(lines[0].split()) <= 4 and len(lines[0]) <= 40)


FEATURES = (
    "log_line_words", "word_length", "letters", "digits", "symbols", "blanks", "common", "clean_tokens", "stops", "marks", "leaders", "cells", "cell_fill", "repeat", "randomness", "short_lines", "entry_words", "longest", "vowels",
)


def block_statistics(lines: list[str]) -> list[float]:
    text = "\n".join(lines)
    n, k = len(text), len(lines)
    toks = _TOKEN.findall(text)
    words = _WORD.findall(text)
    low = [w.lower() for w in words]
    letters = sum(map(len, words))
    digits = sum(c.isdigit() for c in text)
    blanks = sum(c.isspace() for c in text)
    symbols = n - letters - digits - blanks
    common = sum(w in COMMON for w in low) / max(1, len(toks))
    clean = sum(bool(_CLEAN.match(t)) for t in toks) / max(1, len(toks))
    stops = sum(bool(_STOP.search(x.rstrip())) for x in lines) / k
    marks = sum(bool(_MARK.match(x)) for x in lines) / k
    leaders = sum(bool(_LEADER.search(x)) for x in lines) / k
    cells = fill = 0.0
    for d, rx in _SPLIT.items():
        if d.strip() and d not in text:
            continue
        counts = Counter(len(rx.findall(x)) for x in lines)
        if k == 1:
            counts = Counter({c: m for c, m in counts.items()})
        mode, m = max(counts.items(), key=lambda cm: (cm[1] * min(cm[0], 8), cm[0]))
        spaced = 1.0 if d in ("|", "\t", "  ", "<td", "&") else 1 - (text.count(d + " ") / max(1, text.count(d)))
        score = m / k * min(mode, 3) / 3 * spaced * (1.0 if k > 1 or d in ("<td", "|", "\t") else 0.3)
        if score > cells:
            cells, fill = score, mode
    entries = re.split(r"[,;]\s|\n", text)
    raw = text.encode("utf-8", "replace")
    ratio = len(zlib.compress(raw, 1)) / max(1, len(raw))
    distinct = len(set(toks)) / max(1, len(toks)) if len(toks) >= 6 else 1.0
    longest = min(1.0, max((len(t) for t in toks), default=0) / 60)
    return [
        math.log1p(len(toks) / k), min(3.0, math.log1p(n / max(1, len(toks)))), letters / n, digits / n, symbols / n, blanks / n, common, clean, stops, marks, leaders, cells, min(fill, 12) / 12,
        max(0.0, 0.6 - distinct) if len(toks) >= 20 else 0.0, min(ratio, 1.2) if n >= 120 else 0.6, sum(len(x.split()) <= 6 for x in lines) / k,
        math.log1p(min(12.0, len(toks) / max(1, len(entries)))), longest, min(0.6, len(_VOWELS.findall(text)) / letters) if letters >= 8 else 0.39,
    ]


def examples() -> list[tuple[str, list[str]]]:
    """(kind, block) of the inspected examples that name the components; they have no part in the fit. Their matter is everyday life,
    written without regard to any corpus."""
    rng = np.random.default_rng(7)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    en = [
        "My grandmother used to bake bread every Saturday, and the whole street could smell it before noon.",
        "If the soup is too salty, add a potato and let it simmer for another ten minutes.",
        "The ferry leaves at seven, but you should be at the pier earlier because the queue is often long.",
        "She had read the first two chapters on the train; the rest had to wait until the weekend.",
        "Nobody knows who painted the old gate blue, although several neighbours claim to remember the day.",
        "After the storm we walked along the beach and counted 23 broken branches near the path.",
        "The orchestra was late, so the mayor told a story that made even the children in the last row laugh.",
        "Why would anyone plant tomatoes in the shade when there is so much sun behind the house?",
    ]
    figures = [
        "In 1921 the village had 340 people, 12 wells and one school; by 1950 there were 2,100 people and no well at all.",
        "Of 48 runners only 31 reached the lake, and 9 of those were more than 25 minutes behind Marta.",
        "How many apples are left on day 4 if Ida eats 3 of the 27 each morning and Jon takes 5 on Tuesday?",
        "The bus to Holm takes 35 minutes, the one to Vik 50, and both stop for 5 minutes at the mill.",
    ]
    de = ["Am Abend saßen wir noch lange im Garten und sprachen über den Sommer.", "Wenn der Teig zu fest ist, hilft ein wenig warme Milch, aber nicht zu viel.", "Die Fähre war verspätet, weil der Nebel erst gegen Mittag verschwand."]
    es = ["Por la tarde nos quedamos en el jardín y hablamos del verano pasado.", "Si la masa está demasiado dura, conviene añadir un poco de leche tibia.", "El barco salió tarde porque la niebla no se fue hasta el mediodía."]
    fr = ["Le soir, nous sommes restés dans le jardin pour parler de l'été.", "Si la pâte est trop dure, il faut ajouter un peu de lait tiède.", "Le bateau est parti en retard parce que le brouillard était encore là."]
    entry = ["olive oil", "two lemons", "call the dentist", "garden hose 15 m", "README of the club", "water the ferns", "map of Norway", "train_ticket.pdf", "chapter 3", "blue paint", "return library books", "bread, sliced"]
    cell = ["0.75", "1998-11-02", "412", "Bergen", "low", "", "3.9", "north_side", "2001-06-30", "oak", "17", "closed"]
    head = ["town", "height", "rain_mm", "date", "species", "count", "owner", "grade"]
    alnum = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    out: list[tuple[str, list[str]]] = []

    def wrap(text, width):
        lines, line = [], ""
        for w in text.split():
            if len(line) + len(w) > width:
                lines.append(line.strip())
                line = ""
            line += w + " "
        return lines + [line.strip()]

    def text_of(sents, n):
        return " ".join(pick(sents) for _ in range(n))

    def word(letters, a, b):
        return "".join(pick(letters) for _ in range(int(rng.integers(a, b))))

    for _ in range(6):
        n = int(rng.integers(1, 7))
        for sents in (en, de, es, fr):
            out.append(("prose", [text_of(sents, n)]))
            out.append(("prose", wrap(text_of(sents, n), int(rng.integers(45, 90)))))
        out.append(("prose", [pick(en) for _ in range(n)]))
        quiz = text_of(figures, n + 1)
        out.append(("prose", [quiz]))
        out.append(("prose", [re.sub(r" (\w+) (\w+ )", lambda m: f" {pick(['**' + m[1] + '**', '[...]', m[1] + ';', m[1]])} {m[2]}", quiz)]))
        out.append(("prose", [re.sub(r"[.,;]", "", text_of(en, n).lower())]))
        out.append(("prose", [re.sub(r"[.;]\Z", "", pick(en).lower()) for _ in range(n)]))
        out.append(("prose", [text_of(en, n).upper()]))
        out.append(("prose", ["> " + pick(en) for _ in range(n)]))
        m = int(rng.integers(3, 22))
        for mark in ("- ", "* ", "\u2022 ", "[ ] ", "", "+ "):
            out.append(("list", [mark + pick(entry) for _ in range(m)]))
        out.append(("list", [f"{i + 1}. {pick(entry)}" for i in range(m)]))
        out.append(("list", [f"({'abcdefghijklmnopqrstuvwxyz'[i % 26]}) {pick(entry)}" for i in range(m)]))
        out.append(("list", [(pick(entry) + " ").ljust(44, ".") + f" {3 * i + 1}" for i in range(m)]))
        out.append(("list", [", ".join(pick(entry) for _ in range(m + 3)) + "."]))
        out.append(("list", ["; ".join(pick(entry) for _ in range(m + 3))]))
        w = int(rng.integers(4, 7))
        rows = [[pick(head) for _ in range(w)]] + [[pick(cell) for _ in range(w)] for _ in range(m)]
        out.append(("table", [",".join(r) for r in rows]))
        out.append(("table", [";".join(r) for r in rows]))
        out.append(("table", ["\t".join(r) for r in rows]))
        out.append(("table", ["| " + " | ".join(rows[0]) + " |", "|" + "---|" * w] + ["| " + " | ".join(r) + " |" for r in rows[1:]]))
        out.append(("table", [x for r in rows for x in ("+" + ("-" * 15 + "+") * w, "|" + "".join(c.ljust(15) + "|" for c in r))]))
        out.append(("table", ["".join(c.ljust(16) for c in r).rstrip() for r in rows]))
        out.append(("table", ("<table>" + "\n".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>").split("\n")))
        out.append(("junk", ["".join(pick(list("!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~ ")) for _ in range(60 * n))]))
        code = dict(zip("abcdefghijklmnopqrstuvwxyz ,.", rng.permutation(list("ZXKQJVBPYGFWMUCLDRHSNIOATE7&3"))))
        out.append(("junk", ["".join(code.get(c, c) for c in text_of(en, n).lower())]))
        out.append(("junk", [" ".join(word(list("bcdfghjklmnpqrstvwxz"), 2, 12) for _ in range(30 * n))]))
        out.append(("junk", [word(alnum, 76, 77) for _ in range(n * 2)]))
        out.append(("junk", [word(alnum, 200 * n, 200 * n + 1)]))
        out.append(("junk", [f"{i * 16:08x}  " + " ".join(f"{int(rng.integers(256)):02x}" for _ in range(16)) for i in range(m)]))
        out.append(("junk", ["{" + ",".join(f'"{word(alnum, 5, 6)}":[{",".join(str(int(rng.integers(1000))) for _ in range(5))}]' for _ in range(m)) + "}"]))
        out.append(("junk", [f"{int(rng.integers(1990, 2030))}-0{int(rng.integers(1, 10))}-1{int(rng.integers(9))} 1{int(rng.integers(9))}:2{int(rng.integers(9))}:0{int(rng.integers(9))} {pick(['ERROR', 'INFO', 'TRACE'])} pid={int(rng.integers(9999))} [{word(list('0123456789abcdef'), 8, 9)}] {pick(['disk', 'net', 'boot'])}: code {int(rng.integers(99))} after {int(rng.integers(999))}ms" for _ in range(m)]))
        again = pick(["buy now", "la la la", "click here for more", "the end"])
        out.append(("junk", [" ".join([again] * (16 * n))]))
        out.append(("junk", [again] * m * 3))
        out.append(("junk", ["".join(pick(["\ufffd", "\ufffd", "\u00d0", "\u00b1", "e", "\x01", "K", " "]) for _ in range(60 * n))]))
    return out


_BLOCK = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("chars", T.LongType()), *[T.StructField(f, T.DoubleType()) for f in FEATURES]]
)


def _blocks_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        rows = []
        for doc_id, text in zip(df["doc_id"], df["text"]):
            found = blocks(text) if text else []
            titles = [is_title(lines) for lines in found]
            if all(titles):  # nothing else that they could name
                titles = [False] * len(found)
            for lines, title in zip(found, titles):
                rows.append((doc_id, 0 if title else sum(map(len, lines)), *block_statistics(lines)))
        yield pd.DataFrame(rows, columns=_BLOCK.names)


class Mixture:
    """Gaussian mixture with diagonal covariances on standardised statistics."""

    def __init__(self, mean: np.ndarray, std: np.ndarray):
        self.mean0, self.std0 = mean, np.maximum(std, 1e-6)

    def start(self, sample: np.ndarray, components: int, seed: int) -> None:
        """k-means++: every further centre is drawn with a chance that grows with the squared distance to those before."""
        rng = np.random.default_rng(seed)
        centres = [sample[rng.integers(len(sample))]]
        far = ((sample - centres[0]) ** 2).sum(1)
        while len(centres) < components and far.sum() > 1e-9:
            centres.append(sample[rng.choice(len(sample), p=far / far.sum())])
            far = np.minimum(far, ((sample - centres[-1]) ** 2).sum(1))
        self.mu = np.array(centres)
        self.var = np.full_like(self.mu, 0.5)
        self.pi = np.full(len(centres), 1 / len(centres))

    def posterior(self, z: np.ndarray) -> tuple[np.ndarray, float]:
        """Responsibilities of the components, and the sum of the log-likelihoods."""
        logp = np.log(self.pi) - 0.5 * np.log(2 * np.pi * self.var).sum(1) - 0.5 * ((z * z) @ (1 / self.var).T - 2 * z @ (self.mu / self.var).T + (self.mu**2 / self.var).sum(1))
        top = logp.max(1, keepdims=True)
        p = np.exp(logp - top)
        total = p.sum(1, keepdims=True)
        return p / total, float((top + np.log(total)).sum())

    def maximise(self, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> None:
        """From counts, sums and sums of squares per component; one that has less than a block keeps its place."""
        own, n1 = (n > 1)[:, None], np.maximum(n, 1e-9)[:, None]
        mu = s / n1
        self.mu, self.var = np.where(own, mu, self.mu), np.where(own, np.maximum(q / n1 - mu**2, 0) + FLOOR, self.var)
        self.pi = np.maximum(n, 1e-3) / np.maximum(n, 1e-3).sum()

    def kind_of_component(self) -> np.ndarray:
        """Component x kind: votes of the examples nearest to its mean, in standardised statistics."""
        ex = examples()
        z = (np.array([block_statistics(lines) for _, lines in ex]) - self.mean0) / self.std0
        kinds = np.array([KINDS.index(k) for k, _ in ex])
        out = np.zeros((len(self.mu), len(KINDS)))
        for c, mu in enumerate(self.mu):
            far = ((z - mu) ** 2).sum(1)
            near = np.argsort(far, kind="stable")[:NEAREST]
            out[c] = np.bincount(kinds[near], 1 / (far[near] + 0.5), len(KINDS))
        return out / out.sum(1, keepdims=True)


def fit(stats: DataFrame, steps: int = EM_STEPS, seed: int = 1) -> Mixture | None:
    """Expectation-maximisation over all blocks; every step gathers components x statistics sums. None without blocks."""
    d, columns = len(FEATURES), list(FEATURES)
    row = stats.agg(F.count(F.lit(1)).alias("n"), *[f(F.col(c)).alias(f"{n}_{c}") for c in FEATURES for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not row["n"]:
        return None
    m = Mixture(np.array([row[f"m_{c}"] for c in FEATURES]), np.array([row[f"s_{c}"] for c in FEATURES]))
    share = min(1.0, SAMPLE / row["n"])
    drawn = stats.where(F.pmod(F.xxhash64("doc_id", "chars", *columns), F.lit(1_000_000_000)) < int(share * 1_000_000_000)).select(*columns).toPandas()
    drawn = drawn if len(drawn) else stats.select(*columns).limit(1).toPandas()
    m.start((drawn.sort_values(columns).to_numpy() - m.mean0) / m.std0, COMPONENTS, seed)
    schema = T.StructType([T.StructField("c", T.IntegerType()), T.StructField("n", T.DoubleType()), *[T.StructField(f"{p}{i}", T.DoubleType()) for p in "sq" for i in range(d)], T.StructField("ll", T.DoubleType())])
    before = None
    for _ in range(steps):
        shared = stats.sparkSession.sparkContext.broadcast(m)

        def expect(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            g = shared.value
            k = len(g.pi)
            n, s, q, ll = np.zeros(k), np.zeros((k, d)), np.zeros((k, d)), np.zeros(k)
            for df in batches:
                z = (df[columns].to_numpy() - g.mean0) / g.std0
                r, log = g.posterior(z)
                n, s, q = n + r.sum(0), s + r.T @ z, q + r.T @ (z * z)
                ll[0] += log
            yield pd.DataFrame(np.column_stack([np.arange(k), n, s, q, ll]), columns=schema.names).astype({"c": "int32"})

        sums = stats.select(*columns).mapInPandas(expect, schema).groupBy("c").agg(*[F.sum(x).alias(x) for x in schema.names[1:]]).orderBy("c").toPandas()
        shared.unpersist()
        m.maximise(sums["n"].to_numpy(), sums[[f"s{i}" for i in range(d)]].to_numpy(), sums[[f"q{i}" for i in range(d)]].to_numpy())
        now = sums["ll"].sum() / row["n"]
        if before is not None and now - before < TOLERANCE:
            break
        before = now
    return m


def kind_shares(documents: DataFrame, steps: int = EM_STEPS, seed: int = 1) -> DataFrame:
    """doc_id and the characters of each kind."""
    stats = written(documents.select("doc_id", "text").mapInPandas(_blocks_of, _BLOCK), "quality")
    m = fit(stats, steps, seed)
    shared = stats.sparkSession.sparkContext.broadcast((m, m.kind_of_component() if m else None))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(k, T.DoubleType()) for k in KINDS]])

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, names = shared.value
        for df in batches:
            if not len(df):
                continue
            p = g.posterior((df[list(FEATURES)].to_numpy() - g.mean0) / g.std0)[0] @ names
            best = np.zeros_like(p)
            best[np.arange(len(p)), p.argmax(1)] = df["chars"].to_numpy()
            out = pd.DataFrame(best, columns=list(KINDS))
            out.insert(0, "doc_id", df["doc_id"].to_numpy())
            yield out

    return stats.mapInPandas(label, schema).groupBy("doc_id").agg(*[F.sum(k).alias(k) for k in KINDS])


def text_kinds(documents: DataFrame, steps: int = EM_STEPS, seed: int = 1) -> DataFrame:
    """doc_id and text_kind of the documents that are not prose by the larger part of their characters."""
    shares = kind_shares(documents, steps, seed)
    other = [F.col(k) for k in KINDS if k != "prose"]
    most = F.greatest(*other)
    kind = F.when(F.col("prose") >= sum(other[1:], other[0]), "prose").when(F.col("list") == most, "list").when(F.col("table") == most, "table").otherwise("junk")
    return shares.select("doc_id", kind.alias("text_kind")).where("text_kind <> 'prose'")


def statistics(documents: DataFrame) -> DataFrame:
    """Plain figures per document, with built-in expressions only."""
    t = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    common = F.array(*[F.lit(w) for w in sorted(COMMON)])
    df = documents.select("doc_id", t.alias("t"), words.alias("w"), lines.alias("l"))
    n, chars, k = F.size("w"), F.char_length("t"), F.size("l")
    symbols = F.char_length(F.regexp_replace("t", r"[\p{L}\p{N}\s]+", ""))
    stopped = F.size(F.filter("l", lambda x: F.rlike(x, F.lit(r"[.!?:;][)\"']*\s*$"))))
    known = F.size(F.filter("w", lambda w: F.array_contains(common, w)))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)
    return df.select(
        "doc_id", n.cast("bigint").alias("n_words"), ratio(F.aggregate("w", F.lit(0), lambda a, w: a + F.char_length(w)), n).alias("mean_word_length"), ratio(symbols, chars).alias("symbol_ratio"),
        ratio(stopped, k).alias("stopped_lines"), ratio(known, n).alias("common_words"),
    )
