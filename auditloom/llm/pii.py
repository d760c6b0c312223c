"""Problem 1: personal information in free text, by candidate spans and boosted trees.

1. Generators of high recall propose spans, overlapping ones included: emails in plain and disguised spelling,
   groups of digits as phones and as identity numbers, streets and post boxes, pairs of capitalised words. A
   filter inside the JVM keeps texts away from Python that cannot have a candidate: it asks less than the generators do, in every
   alternative, and lets all texts with escapes or invisible characters pass.
2. Every candidate gets format and context features. Gradient-boosted trees (Spark ML), fitted on a bounded
   sample of labelled texts that ``labelled`` writes, score all candidates. The texts are put together from lead-ins, values and
   endings of everyday correspondence and operations, written without regard to any corpus.
3. On held-out labelled texts a threshold per kind is calibrated; what passes is chosen, overlaps go to the better score.

The text is read whole, JSON escapes (\\n, \\uXXXX) are understood, offsets refer to the stored text. ``redact``
replaces the chosen spans by typed placeholders and leaves everything else as it was.

Defined cases: null and empty texts have no findings and no row in the result of ``redacted``; broken JSON is plain text; repeated rows
are cases of their own; ties in score go to the longer, then the earlier span; empty tables give empty results;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.session import written

KINDS = ("email", "phone", "id_number", "address", "name")
SAMPLE_TEXTS = 24_000  # bound of the labelled sample
TREES, DEPTH = 50, 5

# ---- candidates -------------------------------------------------------------------------------------------------

# letters of the Latin, Greek and Cyrillic blocks
_UP = "".join(chr(c) for c in range(0x530) if chr(c).isupper())
_ABC = "".join(chr(c) for c in range(0x530) if chr(c).isupper() or chr(c).islower()) + "'’"
_CAP = rf"[{_UP}][{_ABC}]*(?:-[{_UP}][{_ABC}]*)*"
_WORD = rf"[{_UP}][{_ABC}]+(?:-[{_UP}][{_ABC}]+)*"
_LOCAL = r"(?<![A-Za-z0-9._+\-*])[A-Za-z0-9][A-Za-z0-9._+\-]*"
_HOST = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
EMAIL = re.compile(
    rf"{_LOCAL}(?:(?:@|＠|%40){_HOST}(?:\.{_HOST})+|\s?(?:\(at\)|\[at\]|\{{at\}}|<at>)\s?{_HOST}(?:(?:\.|\s?(?:\[dot\]|\(dot\)|\{{dot\}})\s?){_HOST})+|\s+at\s+{_HOST}(?:\s+dot\s+{_HOST})+)", re.I
)
DIGITS = re.compile(r"(?<![\w.])(?:\+|\(?0|\(?\d)[\d()]*(?:(?: ?\(0\) ?|[ .\-/]{1,2}|\) ?| \()\(?\d+\)?)*(?:\s?(?:ext\.?|x|extension)\s?\d{1,5})?(?!\w)")
_AT = re.compile(r"[(\[{<]at[)\]}>]|\sat\s", re.I)
IDS = re.compile(
    r"(?<![\w\-.])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{9}|\d{4}[ \-]\d{4}[ \-]\d{4}|\d{12}|\d{11}|\d{3}[ .]\d{3}[ .]\d{3}(?:[\- ]\d{2})?"
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]{1,2}-?\d{6,9}[A-Z]?|\d{2}[A-Z]{2}\d{5}|[A-Z]\d{2}[A-Z]\d{5}|\d{8}-?[A-Z])(?![\w\-]|\.\d)"
)
_STREET = "street|st|road|rd|avenue|ave|boulevard|blvd|lane|ln|drive|dr|close|court|ct|way|place|pl|square|terrace|crescent|row|walk|hill|gardens|parkway|mews|quay"
_NO_CITY = r"(?!SSN|NI\b|Aadhaar|Passport|Tax\b|National|Identity|Social|Phone|Tel\b|Fax|Email|Review|Grant|Please|Call|Update|Dr\.|Mr|Mrs|Ms\b|[A-Z]{2}\b)"
_CITY = re.compile(rf"(?:(?:, ?|\n){_NO_CITY}{_WORD}(?: (?:del|de|la|am|an|der|on|upon|of) {_WORD}| {_WORD}){{0,2}},? \d{{4,6}}(?!\d|[ \-]\d)|, ?{_NO_CITY}{_WORD}(?: (?:del|de|la|am|an|der|on|upon|of) {_WORD}| {_WORD}){{0,2}})(?![\w/@])")
_UNIT = r"(?:, ?(?:Apt|Flat|Unit|Suite|Apartment|No)\.? ?\d+[a-z]?)?"
ADDRESS = re.compile(
    rf"(?:(?:\b(?:Flat|Apt|Unit|Suite|Apartment)\.? \d+[a-z]?, ?)?(?<![\w\-.])\d{{1,5}}[a-z]?,? (?:[NSEW]\. )?(?:{_CAP}\.? ){{1,3}}?(?:{_STREET})\b\.?|(?<![\w\-.])\d{{1,5}}[a-z]?,? (?:bis )?(?:rue|avenue|boulevard|place|chemin|impasse) (?:de la |du |des |de |d')?{_CAP}"
    rf"|\b(?:Calle|Avenida|Av|Plaza|Paseo|Via|Rua|Rue)\.? (?:de la |del |de )?{_CAP},? \d{{1,5}}[a-z]?|\b{_CAP}(?:weg|stra(?:ß|ss)e|str\.|gasse|allee|platz|ufer|damm|laan|straat) \d{{1,5}}[a-z]?|\b{_CAP} (?:Stra(?:ß|ss)e|Str\.|Weg|Allee|Platz|Gasse) \d{{1,5}}[a-z]?"
    rf"|\b(?:P\.? ?O\.? ?Box|Postfach|Apartado) \d{{1,6}}|(?<![\w\-.])\d{{1,5}}[a-z]? (?:[NSEW]\. )?{_WORD} {_WORD}){_UNIT}"
)
_STREET_CI = re.compile(rf"\b(?:{_STREET})\b", re.I)
ADDRESS_UPPER = re.compile(rf"(?<![\w\-.])\d{{1,5}}[a-zA-Z]? (?:[A-ZÀ-Ý]{{3,}} ){{1,2}}(?:{_STREET.upper()})\b\.?")
ADDRESS_TITLE = re.compile(
    rf"(?:\b(?:Flat|Apt|Unit|Suite|Apartment)\.? \d+[a-z]?, ?)?(?<![\w\-.])\d{{1,5}}[a-z]?,? (?:[NSEW]\. )?(?:{_WORD} ){{1,2}}(?:{'|'.join(w.title() for w in _STREET.split('|'))})\b\.?{_UNIT}"
)
NAME_START = re.compile(rf"(?<![\w@＠.'’\-/\\])(?=[{_UP}])")
NAME = re.compile(rf"(?:{_WORD},[ ]{_WORD}(?: [{_UP}]\.(?!\w))?|{_WORD},[ ][{_UP}]\.(?!\w)|(?:[{_UP}]\. ?){{1,2}}{_WORD}|{_WORD} (?:[{_UP}]\. )?{_WORD})(?!\w|[@＠]|%40)")

#: Texts without any of these have no candidates; evaluated inside the JVM. Every alternative is implied by a generator's.
PREFILTER = "|".join([
    r"[@＠\u00ad\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]|%40|\\u[0-9a-fA-F]{4}",  # emails; what stands for another character
    r"(?i:[(\[{<]at[)\]}>])|(?i:(?:[\s\p{Z}\x1c-\x1f\x85]|\\[nrt])at(?:[\s\p{Z}\x1c-\x1f\x85]|\\[nrt]))",
    r"\p{Nd}[\p{Nd} ().\-/\\]{5,}\p{Nd}|\p{Nd}\)?(?:[\s\p{Z}\x1c-\x1f\x85]|\\[nrt])?(?:ext|x)|[A-Z]{1,2} ?-?\p{Nd}{2}",  # digits in groups, with an extension, after letters
    r"\p{Nd}[a-zA-Z]?,? (?:\p{Lu}|bis |rue |avenue |boulevard |place |chemin |impasse )",  # number and street
    r"(?:(?<!\p{L})|(?<=\\[nrt]))\p{Lu}\p{L}*+\.?,? [\p{Lu}\p{Nd}]|['’]\p{L}*+\.?,? [\p{Lu}\p{Nd}]|\p{Lu}\. ?\p{Lu}",  # street and number; two names
])

_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|([nrt\"/\\]))|[\u00ad\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_PLAIN = {"n": "\n", "r": "\n", "t": "\t", '"': '"', "/": "/", "\\": "\\"}
_INVISIBLE = re.compile("[\u00ad\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")


def unescape(text: str) -> tuple[str, list[int] | None]:
    """Text with JSON escapes resolved and invisible characters left out, and the offset of each of its characters
    in the stored text (None: the same)."""
    if "\\" not in text and (text.isascii() or not _INVISIBLE.search(text)):
        return text, None
    out, where, at = [], [], 0
    for m in _ESCAPE.finditer(text):
        out.append(text[at : m.start()])
        where.extend(range(at, m.start()))
        if m.group(1) or m.group(2):
            c = chr(int(m.group(1), 16)) if m.group(1) else _PLAIN[m.group(2)]
            if not _INVISIBLE.match(c):
                out.append(c)
                where.append(m.start())
        at = m.end()
    out.append(text[at:])
    where.extend(range(at, len(text) + 1))
    return "".join(out), where


def candidates(t: str) -> list[tuple[int, int, int]]:
    """(start, end, kind index) of every span that could be personal information."""
    out = set()
    if "@" in t or "＠" in t or "%40" in t or _AT.search(t):
        for m in EMAIL.finditer(t):
            out.add((m.start(), m.end(), 0))
    mails = [(a, b) for a, b, _ in out]
    if any(c.isdigit() for c in t):
        for m in DIGITS.finditer(t):
            a, v = m.start(), m.group().rstrip(" .-(/")
            while v.count("(") != v.count(")") or (v[:1] == "(" and v[-1:] == ")"):
                if v[-1] == ")" and (v.count(")") > v.count("(") or v[0] == "("):
                    v = v[:-1]
                elif v[0] == "(":
                    a, v = a + 1, v[1:]
                else:
                    break
            if 7 <= sum(c.isdigit() for c in v) <= 20:
                out.add((a, a + len(v), 1))
        for m in IDS.finditer(t):
            out.add((m.start(), m.end(), 2))
        for rx in (ADDRESS, ADDRESS_UPPER, ADDRESS_TITLE):
            for m in rx.finditer(t):
                out.add((m.start(), m.end(), 3))
                city = _CITY.match(t, m.end())
                if city:
                    out.add((m.start(), city.end(), 3))
    for m in NAME_START.finditer(t):
        n = NAME.match(t, m.start())
        if n and not any(a < n.end() and n.start() < b for a, b in mails):
            out.add((n.start(), n.end(), 4))
            if n.group()[-2:] in ("'s", "’s"):
                out.add((n.start(), n.end() - 2, 4))
    return sorted(out)


# ---- features ---------------------------------------------------------------------------------------------------

# Words that introduce or follow a kind of value.
CUES = {
    "phone": "phone tel telephone call calls mobile cell fax callback text caller dial ring number reach hotline whatsapp sms handset voicemail landline switchboard",
    "id": "ssn social security insurance ni nino passport identity card tax id tin aadhaar national licence license identification personal pan nif dni holder applicant citizen",
    "address": "address lives live office deliver ship visit moved resident street billing located mail send home at residence delivery flat house apartment warehouse studio collect",
    "name": "by dr mr mrs ms prof author name dear hi hello thanks regards contact owner signed-off-by patient account behalf ask assigned reported from for to caller customer colleague manager employee with attn signed approver tenant nurse tutor herr frau",
    "technical": "ticket order section port epoch version commit build revision count line page item step row id hash checksum invoice chapter release code column table issue bug batch serial part meter tracking model lot frame job flight isbn barcode",
}
_CUE = {k: frozenset(v.split()) for k, v in CUES.items()}
# Common nouns and adjectives of titles, organisations, places and products, in alphabetical order.
NOUNS = frozenset(
    "access account admin agency agent annual api app archive area avenue back bank base bay beach big black blue board book box branch bridge build bus business cache calendar candidate card castle centre center central "
    "chapter city client cloud club code college company content contents core council county court crew customer daily dashboard data database date day dead department desk design disk district east editor email engine english error event "
    "express field file files final first forest form french front garden gate gateway general german global gold grand great green group guide hall harbor harbour head health help high home host house hub index institute "
    "island item job journal kernel key keys kit lab lake last layer learning ledger letter library light line list local log logs long los low machine mail main manager map market media memory menu message meta mobile mode model "
    "month mountain museum names nations network new news next night node north notes notice office old only open order page park part password path plan point policy port press primary private product profile project public queue "
    "quick read record red region release report request results review river road role royal rule saint sample san school screen sea search second section security server service session shop silver site small social south space spanish "
    "square staff star start state station status step stop storage store story stream street studio summary support system table task team test theatre time token tools top tour tower town trade user valley version view "
    "village virtual wall water web week west white widget window wood work world year zone".split()
)
_NOUN_END = re.compile(r"(?:tions?|sions?|ments?|ness|ities|ity|ware|ology|ances?|ences?|ship|ics|ings?|tories|ages|ables|ers|ors)\Z")
_TOKENS = re.compile(r"[A-Za-zÀ-ÿ][\wÀ-ÿ\-]*|\d+|[^\w\s]")
FEATURES = (
    *[f"is_{k}" for k in KINDS], "length", "digits", "groups", "first_group", "second_group", "last_group", "plus", "paren", "dashes", "spaces", "dots", "slashes", "lead_zero", "ext", "ssn_shape", "ni_shape", "four_shape", "letter_digits", "nine_digits",
    "street_word", "box", "unit", "number_first", "city", "lower_street", "words", "initials", "comma", "hyphens", "upper", "noun_first", "noun_last", "ending_first", "ending_last", "cue_first", "short_last", "digit_host", "alpha_tld", "disguised",
    *[f"before_{k}" for k in CUES], *[f"after_{k}" for k in CUES], "prev_at", "prev_colon", "prev_equals", "prev_pipe", "prev_paren", "prev_start", "prev_digit", "prev_the", "prev_slash", "prev_capital", "prev_lead", "prev_joint", "next_colon", "next_at", "next_pipe", "next_lt", "next_end",
    "next_verb", "next_to", "next_and", "next_slash", "next_digit", "in_address", "near_mail",
)
_IX = {f: i for i, f in enumerate(FEATURES)}
_CLAUSE_END = re.compile(r"[\n;]|(?<!\bDr)(?<!\bMr)(?<!\bMrs)(?<!\bMs)(?<!\bno)\. | - ")
_NO_STREET = re.compile(r"(?:section|chapter|lane|page|order|ticket|step|version|part|item) \Z", re.I)
_GREETING = frozenset("thanks thank hi hello dear regards sincerely best cheers".split())
_LEAD_WORDS = _CUE["name"] | _GREETING | frozenset("professor doctor sir madam tell call meet please employee resident client guest".split())
_VERBS = frozenset("is was has had will would can could cannot says said writes wrote asks asked tells told calls called wants wanted needs needed left joined moved works worked lives lived signed approved sent got gets agreed thinks before and".split())


def features(t: str, spans: list[tuple[int, int, int]]) -> list[list[float]]:
    addresses = [(a, b) for a, b, k in spans if k == 3 and not _NO_STREET.search(t, max(0, a - 12), a)]
    mails = [(a, b) for a, b, k in spans if k == 0]
    out = []
    for a, b, k in spans:
        v = t[a:b]
        x = [0.0] * len(FEATURES)
        x[k] = 1.0
        groups = re.findall(r"\d+", v)
        nd = sum(map(len, groups))

        def put(name, value, x=x):
            x[_IX[name]] = float(value)

        put("length", min(len(v), 80))
        put("digits", nd)
        put("groups", len(groups))
        if groups:
            put("first_group", len(groups[0]))
            put("second_group", len(groups[1]) if len(groups) > 1 else 0)
            put("last_group", len(groups[-1]))
            put("lead_zero", groups[0][0] == "0")
        if k in (1, 2):
            put("plus", v[0] == "+")
            put("paren", "(" in v)
            put("dashes", v.count("-"))
            put("spaces", v.count(" "))
            put("dots", v.count("."))
            put("slashes", v.count("/"))
            put("ext", bool(re.search(r"(?:ext|x)", v)))
            put("ssn_shape", bool(re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}", v)))
            put("ni_shape", bool(re.fullmatch(r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]", v)))
            put("four_shape", bool(re.fullmatch(r"\d{4}[ \-]\d{4}[ \-]\d{4}", v)))
            put("letter_digits", bool(re.fullmatch(r"[A-Z]{1,2}-?\d{6,9}[A-Z]?", v)))
            put("nine_digits", bool(re.fullmatch(r"\d{9}", v)))
        elif k == 3:
            put("street_word", bool(_STREET_CI.search(v)) or bool(re.search(r"(?i)\b(?:rue|calle|avenida|plaza|via)\b|weg \d|stra(?:ß|ss)e \d|gasse \d|allee \d|platz \d|straat \d|laan \d", v)))
            put("box", bool(re.search(r"(?i)box|postfach|apartado", v)))
            put("unit", bool(re.search(r"\b(?:Flat|Apt|Unit|Suite)\b", v)))
            put("number_first", v[0].isdigit())
            put("city", bool(re.search(r"[,\n]", v)))
            put("lower_street", bool(re.search(r"\b(?:street|road|lane|way|drive)\b", v)))
        elif k == 4:
            parts = [p for p in re.split(r"[ ,]+", v) if p]
            low = [p.lower().strip(".") for p in parts]
            if "," in v:
                low = low[1:] + low[:1]  # family name first
            put("words", len(parts))
            put("initials", sum(len(p.strip(".")) == 1 for p in parts))
            put("comma", "," in v)
            put("hyphens", v.count("-"))
            put("upper", v.upper() == v)
            put("noun_first", low[0] in NOUNS)
            put("noun_last", low[-1] in NOUNS)
            put("cue_first", low[0] in _LEAD_WORDS)
            put("ending_first", bool(_NOUN_END.search(low[0])))
            put("ending_last", bool(_NOUN_END.search(low[-1])))
            put("short_last", len(low[-1]) <= 3)
            put("in_address", any(p < b and a < q for p, q in addresses))
            put("near_mail", any(0 <= p - b <= 14 for p, _ in mails))
        else:
            host = re.split(r"(?i)@|＠|%40|\(at\)|\[at\]|\{at\}|<at>| at ", v)[-1]
            put("digit_host", bool(re.match(r"\s?\d", host)))
            put("alpha_tld", bool(re.search(r"[A-Za-z]{2,}\Z", host)))
            put("disguised", "@" not in v)
        before = _TOKENS.findall(_CLAUSE_END.split(t[max(0, a - 60) : a])[-1])
        after = _TOKENS.findall(_CLAUSE_END.split(t[b : b + 40])[0])
        near, far = [w.lower() for w in before[-3:]], {w.lower() for w in after[:4]}
        if "," in near:  # before the comma is another clause, unless it is a greeting
            at = len(near) - 1 - near[::-1].index(",")
            near = near[at + 1 :] or [w for w in near[:at] if w in _GREETING]
        near = set(near)
        for c, words in _CUE.items():
            x[_IX[f"before_{c}"]] = float(bool(near & words))
            x[_IX[f"after_{c}"]] = float(bool(far & words))
        p, n = (before[-1] if before else ""), (after[0] if after else "")
        put("prev_at", p in ("@", "＠"))
        put("prev_colon", p == ":")
        put("prev_equals", p == "=")
        put("prev_pipe", p in ("|", ";"))
        put("prev_paren", p in ("(", "<"))
        put("prev_start", a == 0 or t[:a].rstrip(" ")[-1:] in ("\n", '"', "") or t[:a].rstrip()[-1:] in ".;,-")
        put("prev_digit", p.isdigit())
        put("prev_the", p.lower() in ("the", "a", "an", "see", "section"))
        put("prev_slash", t[a - 1 : a] in ("/", "\\", "_"))
        put("prev_lead", p.lower() in _LEAD_WORDS)
        put("prev_joint", p.lower() in ("and", "or", "und", "y", "et"))
        put("prev_capital", bool(p) and p[0].isupper())
        put("next_colon", n == ":" and not t[b : b + 2].endswith(" "))
        put("next_at", n in ("@", "＠"))
        put("next_pipe", n in ("|", ";"))
        put("next_lt", n == "<")
        put("next_end", b == len(t) or t[b : b + 1] in "\n\".;,)")
        put("next_verb", n.lower() in _VERBS)
        put("next_to", n.lower() == "to")
        put("next_and", n.lower() in ("and", "are"))
        put("next_slash", t[b : b + 1] in ("/", "\\", "_"))
        put("next_digit", n.isdigit())
        out.append(x)
    return out


# ---- labelled texts ---------------------------------------------------------------------------------------------

_FIRST = "Alice Bruno Carla Dmitri Elif Fatou Gustav Hiro Ivana Jorge Katrin Lars Mina Nils Olga Pedro Quentin Rosa Stella Tariq Ulrike Vera Wendy Xenia Yusuf Zoe April Dawn Hope Hunter Mason Victor Summer Ivy Pearl Frank Chase Drew Reed Guy".split()
_LAST = "Abernathy Brandvold Castellanos Dunkirk Eriksson Falkenrath Gruszka Hollister Ibarra Jovanovic Kirkwood Lindqvist Moreau Nakashima Oyelaran Pemberton Quiroga Rothwell Szabo Tremblay Underwood Villanueva Whitcombe Xanthos Yilmaz Zielinski Bélanger Müller Gärtner Åkesson Renwick Talbrook Corvelli Drumgold Estermann Fosterly Hawkmoor Jaspersen Ketterick Norwall".split()
_STEMS = "Maple Thorn Ash Willow Stone Raven Birch Copper Linden Falcon Mill Orchard Silver Briar Heron Walnut Clover Garnet".split()
_TAILS = "ford wood field brook gate ridge mere den hurst bury".split()
_CITIES = "Ravensburgh|Lower Thornby|Santa Molina|Grünfeld|Ostmark Bay|Bad Lindau|Pine Hollow|Puerto del Rey|Marchmont|Alt-Weiden|Harrowgate|Stillwater Springs".split("|")
_TITLES = "Street|Road|Rd|Avenue|Ave.|Boulevard|Lane|Drive|Close|Court|Place|Square|Terrace|St.".split("|")
_HOSTS = "northgale brightwell mailbox.cedarline oak-harbour post.silverfen quayside lantern.westmoor".split()
_TLD = "example test invalid org net com".split()
# Lead-ins and endings are put together freely; an empty one is as good as any.
_LEADS = {
    "email": "|||write to |forward it to |my new account is |bounced: |mailbox |user |login: |owner=|to: <|sent from |subscribe |please copy |registered as |recovery mail |invoices go to |mailto:|cc ",
    "phone": "|||phone |tel. |mobile: |fax |you get me on |ring |dial |hotline |her number is |text me on |voicemail at |call |emergency contact |sms to |handset |phone=|after hours |front desk |direct line |the line is |is now |under ",
    "address": "||lives in |delivery to |ship to |invoice address: |our office is |moving to |collect it from |the flat at |residence: |meet me at |branch at |send the parcels to |warehouse: |home address |located at |pick up from ",
    "name": "|||with |signed |meeting with |Mr |Mrs |Dr. |Prof. |approver: |attn. |dear |Hi |tenant |the file of |forwarded by |written by |name: |author = |spoke to |thanks to |manager |nurse |ask |call |for |according to |caller |from |to |we miss |hired |tell |professor |thank |meet |employee |guest |{role} |{role} |our {role} |{role}, |tell |ask |hired {other} and |{other} and |{other}, |coached by |owner |did |why did |when does |where is |has |",
}
_ENDS = {
    "email": "|||> |, please| is the right one| does not answer| got no invitation|; thanks| wants to know|&lang=en| has been disabled| should be removed|) |, not the old one",
    "phone": "||| after lunch| on weekdays| (private)| is engaged| does not work|, ask for the desk| until noon|; thanks| or leave a message| was wrong|, thanks",
    "address": "||| by Friday| is closed|, ring twice| (second door)| since May|; thanks| was damaged| or next door| please",
    "name": "||| agreed| will join us on Monday| has left the company| is out of office| wrote this| (finance)|'s laptop| called twice| needs a badge| wants a refund| and the others| signed it|, accounting| was not there| asks for help| told me so| cannot print| joined in May| and {other}|, {other} and others| approve this?| pay twice?| leave early?| approved it",
}
_CARDS = "{v} <{mail}>|Reviewed-by: {v} <{mail}>|Committer: {v} <{mail}>|{v} ({mail})|{h};{v};{mail};typo|{h},{v},{mail}|{h} {v} <{mail}> docs|contact {v}, {mail}|{v}\n{addr}\n{tel}|{v}, {addr}, {tel}|{v}; {tel}; {mail}|Regards,\n{v}\n{addr}|{v}, {addr}|{v}, {tel}, SSN {ssn}|{v}, {addr}, SSN {ssn}|{addr}\n{tel}\n{v}|{v}, SSN {ssn}|{v}\n{tel}"
_NUMBERS = {
    "ssn": "SSN {v}|SSN: {v}|ssn={v}|social security no. {v}|her social is {v}|{v}|we need {v} for payroll|W-2 with {v}|tax id {v}|taxpayer {v}|TIN {v}|tax number: {v}|{v} is on the form|on file: {v}|please check {v}",
    "bare": "SSN {v}|ssn={v}|social security no. {v}|TIN {v}|tax number {v}|SSN: {v} (payroll)",
    "ni": "NI {v}|national insurance no. {v}|NINO: {v}|{v}|{v} is on the payslip|insured under {v}|insurance no. {v}|payslip says {v}",
    "passport": "passport {v}|passport number {v}|travels on passport {v}|passport: {v}, valid to May|Passport no {v} was stolen",
    "card": "identity card {v}|ID card no. {v}|identity document {v}|ID: {v} (copy attached)|personal id {v}|lost identity card {v}",
    "aadhaar": "Aadhaar {v}|Aadhaar no. {v}|national identity no. {v}|national id {v}|Aadhaar: {v} (copy)|national ID number {v}",
}
_TECH = "order no. {n}-{m}-{n}|job {y}-{m}-{m} done|serial {n}-{n}-{n}|lot {n}{n}-{d}|took {d}.{n}.{n}.{d} hops|firmware {d}.{m}.{n}.{d}|at {e} the clock stopped|freed 0x{h}|merge {h}{h}|pin lib@{d}.{m}.{d}|git@{host}:apps/site.git is slow|s***@{host}.org is masked|follow @{w}_{w} there|@{w}.cached is a decorator|listens on {n} for {m} clients|the SSN field is hashed|no phone number on file|[EMAIL] was removed|phone [PHONE], name [NAME]|author bot <[EMAIL]>|invoice {y}/{n}/{n} is paid|{n} rows read, {m} kept|part {n}-{n}-{n}|build {e}|run {n}{n}{m} in {n} ms|{y}-{m}-{m} {m}:{m}:{m} start|pages {n}-{n} of {n}|ISBN {n}-{d}-{n}-{n}-{d}|our PO box is empty|{n} open items|host 10.{m}.{m}.{d}|ip {q}.{q}.{q}.{q}|{q}.{q}.{q}.{q} was blocked|from {q}.{q}.{q}.{d} on port {n}|matrix {n} {n} {n}|card no. ends in {n}|series {n} {m} {n}|tag {m}.{m}.{n}|hash {h} of {p}|factor {d}.{n}|meter {n} {n} {n} kWh|frame {n} x {n}|flight {n} at {m}:{m}|tracking {n}{n}{n}|id {n}-{n}-{n}|ref {m}/{n}/{n}|code {n}-{m}-{n} expired|barcode {n} {n} {n}|between {n} and {n} units|{m} Main Results|{n} New Items|{n} Old Entries, see below"
_TITLES_OF = "the {a} {b}|see {A} {B}|{A} {B} in {p}|chapter {m} {A} {B}|section {m} {A} {B}|part {m}: {A} {B}|the {A} {B} team|{A} {B} is down|{A} {B} for beginners|a {A} {B} and a {A} {B}|page {m} {A} {B}|{A} {B} failed|open {A} {B}|{s} {B} is our product|the {s} {B}|{s} {B} and {s} {A} are products|{A} Name and {A} {B} are columns|from the {A} {B}|with {A} {B}|for {A} {B}|{A} {B}|to {A} {B} users|United {B}|Saint {s}burg|New {s}|{f} {B} and {f} {A} are nicknames of services|{f} {B} is a dashboard|lane {m} of the {s} {B}|the {A} {B} and the {A} {B}|{a} Learning|Best {B} of {y}"
_PLAIN_TEXT = "please open {p}|what changed in {p}|compare the two drafts|sort these rows by date|list all late items|count the words in {p}|the page loads slowly|why is {p} so large|remove blank lines|the test is flaky since Monday|show me {n} recent entries|merge both tables|explain this error|nothing to report|update the docs|is {p} still in use|we ship on Friday|the lamp in room {m} is broken|see you at {m} past|Lunch is at noon|Try again Later"


_SLOT_KIND = {"mail": 0, "tel": 1, "ssn": 2, "addr": 3, "other": 4}
_SYLLABLES = "ka lo mi ra zen dor wei ang osh ber tal nik va so fe li jun ho mar ti gra el is an der son ov ek sky kim sa tu pol bri can dia car hel ost rin gu".split()
_ROLES = "driver pilot chef judge clerk intern coach farmer editor deputy minister sister uncle aunt captain officer plumber trainee guide painter singer bishop mayor sergeant librarian architect student witness juror baker".split()
_NOUN_LIST = sorted(NOUNS)
_TITLE_WORDS = "learning virtual handling contents settings notifications practices questions options payments shipping training insurance software security finance statistics graphics ownership analysis weather kitchen harvest winter lantern forward deep dive wins lessons learned pros cons ideas caveats roadmap backlog scope cost risk checklist glossary appendix preface outlook recap basics tips tricks closing remarks early late better faster".split()


class _Writer:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, xs):
        return xs[int(self.rng.integers(len(xs)))]

    def n(self, a, b):
        return int(self.rng.integers(a, b))

    def digits(self, k):
        return "".join(str(self.n(0, 10)) for _ in range(k))

    def fill(self, template: str) -> str:
        out = re.sub(r"\{(\w+)\}", lambda m: self.slot(m.group(1)), template)
        return out

    def slot(self, s: str) -> str:
        if s in ("n", "m", "d", "y", "e"):
            return {"n": lambda: str(self.n(100, 9999)), "m": lambda: str(self.n(10, 60)), "d": lambda: str(self.n(0, 10)), "y": lambda: str(self.n(2000, 2060)), "e": lambda: "1" + self.digits(self.n(9, 12))}[s]()
        if s == "role":
            return self.pick(_ROLES).title() if self.n(0, 3) else self.pick(_ROLES)
        if s == "q":
            return str(self.n(1, 256))
        if s == "h":
            return "".join(self.pick("0123456789abcdef") for _ in range(7))
        if s in "aAbB":
            w = self.pick(_NOUN_LIST) if self.n(0, 3) else self.pick(_TITLE_WORDS)
            return w.title() if s.isupper() or self.n(0, 2) else w
        if s == "p":
            return self.pick(["app/", "docs/", "tools/", "web/"]) + self.pick(["start", "menu", "cart", "notes"]) + self.pick([".py", ".ts", ".md", ".yml"])
        if s == "w":
            return self.pick(["heron", "lamp", "otter", "kite"])
        if s == "s":
            return self.pick(_STEMS)
        if s == "f":
            return self.pick(_FIRST)
        if s == "host":
            return self.pick(_HOSTS)
        if s in _SLOT_KIND:
            return {"mail": lambda: self.email(plain=True), "tel": self.phone, "addr": self.address, "other": self.name, "ssn": lambda: f"{self.digits(3)}-{self.digits(2)}-{self.digits(4)}"}[s]()
        raise KeyError(s)

    def email(self, plain=False) -> str:
        f, last = self.pick(_FIRST).lower(), re.sub(r"[^a-z]", "x", self.pick(_LAST).lower())
        local = self.pick([f"{f}.{last}", f"{f[0]}{last}", f"{f}{last[0]}", f"{last}+{self.pick(['dev', 'alerts', 'x'])}", f"{f}_{last}{self.n(1, 99)}"])
        host = f"{self.pick(_HOSTS)}.{self.pick(_TLD)}"
        how = 0 if plain else self.n(0, 10)
        if how < 5:
            v = f"{local}@{host}"
        elif how == 5:
            v = f"{local}%40{host}"
        elif how == 6:
            v = f"{local} (at) {host}"
        elif how == 7:
            v = f"{local}[at]{host.replace('.', '[dot]')}"
        elif how == 8:
            v = f"{local} at {host.replace('.', ' dot ')}"
        else:
            v = f"{local}＠{host}"
        return v.upper() if how < 5 and self.n(0, 6) == 0 else v

    def phone(self) -> str:
        d = self.digits
        return self.pick([
            lambda: f"+1 {d(3)} 555 {d(4)}", lambda: f"({d(3)}) 555-{d(4)}", lambda: f"{d(3)}-555-{d(4)}", lambda: f"+1{d(10)}", lambda: f"1.{d(3)}.555.{d(4)}", lambda: f"{d(3)} 555 {d(4)} ext. {d(3)}", lambda: f"+44 20 {d(4)} {d(4)}", lambda: f"+44 (0)20 {d(4)}-{d(4)}",
            lambda: f"020 {d(4)} {d(4)}", lambda: f"0{self.n(1, 7)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"+33 {self.n(1, 7)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"+49 {d(2)} {d(5)} {d(3)}", lambda: f"0049-{d(2)}-{d(8)}", lambda: f"030/{d(7)}", lambda: f"+34 {d(3)} {d(3)} {d(3)}",
        ])()

    def id_number(self) -> tuple[str, list[str]]:
        d = self.digits
        k = self.n(0, 8)
        if k < 2:
            return f"9{d(2)}-{d(2)}-{d(4)}" if self.n(0, 2) else f"{d(3)}-{d(2)}-{d(4)}", _NUMBERS["ssn"].split("|")
        if k == 2:
            return f"{d(3)} {d(2)} {d(4)}", _NUMBERS["bare"].split("|")
        if k == 3:
            return d(9), _NUMBERS["bare"].split("|")
        if k == 4:
            v = f"{self.pick(['QQ', 'AB', 'JK'])}{{0}}{d(2)}{{0}}{d(2)}{{0}}{d(2)}{{0}}{self.pick('ABCD')}".replace("{0}", self.pick(["", " "]))
            return v, _NUMBERS["ni"].split("|")
        if k == 5:
            return f"{self.pick('ACEKXYZ')}{d(self.n(7, 9))}", _NUMBERS["passport"].split("|")
        if k == 6:
            return f"{self.pick(['XX', 'LN', 'C'])}-{d(6)}", _NUMBERS["card"].split("|")
        return f"0{d(3)} {d(4)} {d(4)}", _NUMBERS["aadhaar"].split("|")

    def address(self) -> str:
        street = self.pick(_STEMS) + self.pick(_TAILS)
        num, city = str(self.n(1, 5000)), self.pick(_CITIES)
        v = self.pick([
            lambda: f"{num} {street} {self.pick(_TITLES)}", lambda: f"{num} {street} {self.pick(_TITLES)}, {city}", lambda: f"{num} {self.pick('NSEW')}. {street} Ave., Apt {self.n(1, 40)}, {city} {self.digits(5)}", lambda: f"PO Box {num}, {city} {self.digits(5)}", lambda: f"PO Box {num}",
            lambda: f"Flat {self.n(1, 30)}, {self.n(1, 200)} {street} Close", lambda: f"{self.n(1, 200)}b {street} Rd, {city}", lambda: f"{self.n(1, 99)} rue de {street}, {city}", lambda: f"Calle {street} {self.n(1, 99)}, {city}", lambda: f"{street}weg {self.n(1, 99)}", lambda: f"{street}er Straße {self.n(1, 150)}, {city}",
            lambda: f"{num} {street} Boulevard\n{city}, {self.digits(5)}", lambda: f"{num} {street.upper()} {self.pick(['DRIVE', 'ROAD', 'AVENUE', 'LANE'])}", lambda: f"{street}straße {self.n(1, 150)}",
        ])()
        return v

    def name(self) -> str:
        made = lambda: "".join(self.pick(_SYLLABLES) for _ in range(self.n(1, 4))).title()
        f = self.pick(_FIRST) if self.n(0, 3) else made()
        last = self.pick([lambda: self.pick(_LAST), made, made, lambda: self.pick(_STEMS) + self.pick(["sen", "elli", "ovich", "quist", "hardt", "combe", "uela", "ardsen"])])()
        return self.pick([
            lambda: f"{f} {last}", lambda: f"{f} {last}", lambda: f"{f} {last}", lambda: f"{f} {last}".upper(), lambda: f"{f}-{self.pick(_FIRST)} {last}", lambda: f"{f} {last}-{self.pick(_LAST)}", lambda: f"{last}, {f}", lambda: f"{f[0]}. {last}", lambda: f"{f} {self.pick('ABCDEFGHJKLM')}. {last}",
        ])()

    def clause(self) -> tuple[str, list[tuple[int, int, int]]]:
        r = self.n(0, 100)
        if r < 22:
            return self.fill(self.pick(_PLAIN_TEXT.split("|"))), []
        if r < 42:
            return self.fill(self.pick(_TECH.split("|"))), []
        if r < 52:
            return self.fill(self.pick(_TITLES_OF.split("|"))), []
        kind = self.pick(KINDS)
        if kind == "id_number":
            v, ctx = self.id_number()
        else:
            v, ctx = getattr(self, kind)(), None
        if ctx:
            template = self.pick(ctx)
        elif kind == "name" and self.n(0, 4) == 0:
            template = self.pick(_CARDS.split("|"))
        else:
            lead = self.pick(_LEADS[kind].split("|"))
            template = (lead[:1].upper() + lead[1:] if self.n(0, 2) else lead) + "{v}" + self.pick(_ENDS[kind].split("|"))
        text, spans, at = "", [], 0
        for m in re.finditer(r"\{(\w+)\}", template):
            text += template[at : m.start()]
            if m.group(1) == "v":
                spans.append((len(text), len(text) + len(v), KINDS.index(kind)))
                text += v
            else:
                part = self.slot(m.group(1))
                if m.group(1) in _SLOT_KIND:
                    spans.append((len(text), len(text) + len(part), _SLOT_KIND[m.group(1)]))
                text += part
            at = m.end()
        return text + template[at:], spans

    def text(self) -> tuple[str, list[tuple[int, int, int]]]:
        sep = self.pick(["; ", ". ", ", ", " - ", "\n"])
        out, spans = "", []
        for _ in range(self.n(1, 5)):
            c, s = self.clause()
            if out:
                out += sep
            spans += [(a + len(out), b + len(out), k) for a, b, k in s]
            out += c
        if self.n(0, 3) == 0:
            lead = self.pick(['{"text": "', '{"mail": {"content": "', '{"reply": "', '{"comment": "'])
            return lead + out + self.pick(['", "limit": 9}', '"}', ""]), [(a + len(lead), b + len(lead), k) for a, b, k in spans]
        return out, spans


def is_right(t: str, span: tuple[int, int, int], truth: list[tuple[int, int, int]]) -> bool:
    a, b, k = span
    for p, q, kind in truth:
        if kind != k or b <= p or q <= a:
            continue
        if k == 3:
            return a >= p - 1 and b <= q + 1 and (a <= p + 1 or (b - a) >= 0.5 * (q - p))
        if k == 4:
            return abs(a - p) <= 1 and abs(b - q) <= 1
        return min(b, q) - max(a, p) >= 0.8 * (q - p) and b - a <= (q - p) + 4
    return False


def labelled(seed: int, n: int) -> list[tuple[list[float], int, float]]:
    """(features, kind, label) of the candidates of n labelled texts."""
    w = _Writer(seed)
    out = []
    for _ in range(n):
        t, truth = w.text()
        spans = candidates(t)
        for s, x in zip(spans, features(t, spans)):
            out.append((x, s[2], float(is_right(t, s, truth))))
    return out


# ---- model ------------------------------------------------------------------------------------------------------

_FITTED: dict[str, tuple[GBTClassificationModel, list[float]]] = {}


def fit(spark: SparkSession, n_texts: int = SAMPLE_TEXTS, seed: int = 11) -> tuple[GBTClassificationModel, list[float]]:
    """Boosted trees and a threshold per kind; fitted once per application on ``n_texts`` labelled texts, of which a third
    is held out to calibrate the thresholds (the middle of the scores with the best F1)."""
    key = f"{spark.sparkContext.applicationId}-{n_texts}-{seed}"
    if key in _FITTED:
        return _FITTED[key]
    schema = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("kind", T.IntegerType()), T.StructField("label", T.DoubleType())])
    parts = max(3, n_texts // 1_500)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for part in df["id"]:
                yield pd.DataFrame(labelled(seed * 1_000 + part, n_texts // parts), columns=schema.names).assign(held=part % 3 == 0)

    sample = written(spark.range(0, parts, 1, parts).mapInPandas(write, T.StructType([*schema, T.StructField("held", T.BooleanType())])).withColumn("features", array_to_vector("x")), "labelled")
    train, test = sample.where("NOT held").coalesce(4), sample.where("held")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=seed, maxBins=32, cacheNodeIds=False).fit(train)
    scored = model.transform(test).select("kind", "label", vector_to_array("probability")[1].alias("p")).toPandas()
    thresholds = []
    for k in range(len(KINDS)):
        part = scored[scored.kind == k]
        best, cut = -1.0, 0.5
        values = np.unique(np.round(part.p.to_numpy(), 4)) if len(part) else np.array([0.5])
        for lo, hi in zip(np.r_[0.0, values], np.r_[values, 1.0]):
            mid = (lo + hi) / 2
            tp = ((part.p >= mid) & (part.label == 1)).sum()
            f1 = 2 * tp / max(1, (part.p >= mid).sum() + (part.label == 1).sum())
            if f1 > best + 1e-9 or (abs(f1 - best) <= 1e-9 and abs(mid - 0.5) < abs(cut - 0.5)):
                best, cut = f1, mid
        thresholds.append(float(cut))
    _FITTED[key] = (model, thresholds)
    return _FITTED[key]


# ---- operator ---------------------------------------------------------------------------------------------------


def texts(audit_logs: DataFrame, tool_requests: DataFrame) -> DataFrame:
    """source_table, record_id, field, text of every searched field."""
    logs = audit_logs.select(
        F.lit("audit_logs").alias("source_table"), F.col("id").alias("record_id"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("tool_input", "tool_output_sanitized")])).alias("f"),
    ).select("source_table", "record_id", "f.*")
    intents = tool_requests.select(F.lit("tool_requests").alias("source_table"), F.col("req_id").alias("record_id"), F.lit("user_stated_intent").alias("field"), F.col("user_stated_intent").alias("text"))
    return logs.unionByName(intents).where("text IS NOT NULL AND text <> ''")


_CAND = T.StructType(
    [T.StructField("source_table", T.StringType()), T.StructField("record_id", T.LongType()), T.StructField("field", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))]
)


def _propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        rows = []
        for source, rid, field, text in zip(df["source_table"], df["record_id"], df["field"], df["text"]):
            t, where = unescape(text)
            spans = candidates(t)
            for (a, b, k), x in zip(spans, features(t, spans)):
                rows.append((source, rid, field, where[a] if where else a, where[b] if where else b, k, x))
        yield pd.DataFrame(rows, columns=_CAND.names)


def chosen(found_in: DataFrame, n_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """source_table, record_id, field and spans (start, end, kind) selected in each text that has any."""
    spark = found_in.sparkSession
    model, thresholds = fit(spark, n_texts)
    proposed = found_in.where(F.rlike("text", F.lit(PREFILTER))).mapInPandas(_propose, _CAND)
    scored = model.transform(proposed.withColumn("features", array_to_vector("x"))).withColumn("p", vector_to_array("probability")[1])
    cut = F.element_at(F.array(*[F.lit(v) for v in thresholds]), F.col("kind") + 1)
    passed = scored.where(F.col("p") >= cut).select("source_table", "record_id", "field", F.struct("start", "end", "kind", "p").alias("s"))
    grouped = passed.groupBy("source_table", "record_id", "field").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return grouped.select("source_table", "record_id", "field", _select("s").alias("spans"))


_SPANS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "end", "kind")]))


@F.pandas_udf(_SPANS)
def _select(groups: pd.Series) -> pd.Series:
    return pd.Series([resolve([(s["start"], s["end"], s["kind"], s["p"]) for s in g]) for g in groups])


def resolve(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Spans without overlap: the best scores first, each widened to the longest span of its kind that is free."""
    taken: list[tuple[int, int, int, float]] = []
    for s in sorted(spans, key=lambda s: (-s[3], s[0] - s[1], s[0])):
        over = [o for o in taken if o[0] < s[1] and s[0] < o[1]]
        if not over:
            taken.append(s)
        elif all(o[2] == s[2] and s[0] <= o[0] and o[1] <= s[1] for o in over):
            taken = [o for o in taken if o not in over] + [s]
    return [(a, b, k) for a, b, k, _ in sorted(taken)]


def found(audit_logs: DataFrame, tool_requests: DataFrame) -> DataFrame:
    """source_table, record_id, field, pii_type: a row per text and kind of value in it."""
    spans = chosen(texts(audit_logs, tool_requests)).select("source_table", "record_id", "field", F.explode(F.array_distinct("spans.kind")).alias("k"))
    return spans.select("source_table", "record_id", "field", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("k") + 1).alias("pii_type"))


_ABBREVIATED = re.compile(r"(?i)\b(?:ave|st|rd|blvd|dr|ln|ct|pl|str)\.\Z")


@F.pandas_udf(T.StringType())
def _replace(text: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, ss in zip(text, spans):
        if ss is None or len(ss) == 0:
            out.append(t)
            continue
        parts, at = [], 0
        for s in ss:
            parts += [t[at : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
            at = s["end"]
            if s["kind"] == 3 and t[at - 1] == "." and not _ABBREVIATED.search(t, s["start"], at):
                at -= 1  # the stop belongs to the sentence
        out.append("".join(parts) + t[at:])
    return pd.Series(out)


def redacted(audit_logs: DataFrame, tool_requests: DataFrame) -> DataFrame:
    """Every text with its values replaced by typed placeholders, and the number of values."""
    every = texts(audit_logs, tool_requests)
    keys = ["source_table", "record_id", "field"]
    joined = every.join(chosen(every), keys, "left")
    return joined.select(*keys, _replace("text", "spans").alias("text"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_values"))
