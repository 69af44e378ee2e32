"""Personal data, plain and disguised, with offsets into the source text.

Plain data is found by four patterns. For disguised data a text passes through
transducers that rewrite it piece by piece and keep, for every character they
emit, the source characters it stands for: look-alike letters, wide forms and
zero-width characters; spelled digits; at and dot in words or brackets. A lone
"at" before a domain with plain dots is read where what stands before it is no
prose (``_named``); "jane at example.com" without a cue stays out. The
patterns run again on the rewritten text, and what they find there, if it holds
a rewritten piece and meets no plain find of its kind, is mapped back.

A text is one row of a scan: nothing is shuffled. Every step is linear in the
text, whatever it holds.

Defined cases: a null text is empty and has no spans; null ids and repeated
rows keep a row each; an empty table gives an empty one; columns other than the
id and the text are not looked at (``redact`` keeps them).
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]*+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """By the ``@``: the run before it, back to the last find, and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1  # what stands before this @ cannot be part of a later find
        at = text.find("@", done)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub("[^0-9]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}

# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
# Characters without width.
NO_WIDTH = "­​‌‍‎‏⁠﻿"
# The digits in words (English, French, German, Spanish).
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7",
    "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9",
}
_AT = "at|arroba|ät|chez"
_DOT = "dot|point|punkt|punto"
#: Shortest run of spelled digits that is read as a number.
SPELLED_RUN = 3

_WORD_DIGIT = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_DIGIT_RUN = re.compile(rf"(?<!\w){_WORD_DIGIT}(?!\w)(?:[\x20\t]*+[-,]?+[\x20\t]*+{_WORD_DIGIT}(?!\w))*+", re.I)
_ONE_DIGIT = re.compile(rf"(?<!\w){_WORD_DIGIT}(?!\w)", re.I)
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_BRACKET_AT = re.compile(rf"[\x20\t]*+{_OPEN}[\x20\t]*+(?:{_AT}|@|a)[\x20\t]*+{_CLOSE}[\x20\t]*+", re.I)
_BRACKET_DOT = re.compile(rf"[\x20\t]*+{_OPEN}[\x20\t]*+(?:{_DOT}|\.)[\x20\t]*+{_CLOSE}[\x20\t]*+", re.I)
_LABEL = r"[A-Za-z0-9][A-Za-z0-9-]*+"
_SAID = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:(?:\.|[\x20\t]+(?:{_DOT})[\x20\t]+)[A-Za-z0-9_%+-]++)*+"
    rf"(?P<at>[\x20\t]+(?:{_AT})[\x20\t]+|@){_LABEL}(?:(?:\.|[\x20\t]+(?:{_DOT})[\x20\t]+){_LABEL})++", re.I,
)
_SPACED = re.compile(rf"[\x20\t]+(?:{_AT}|{_DOT})[\x20\t]+", re.I)
_SAID_DOT = re.compile(rf"(?<=[0-9])[\x20\t]+(?:{_DOT})[\x20\t]+(?=[0-9])", re.I)
_SAID_PLUS = re.compile(r"(?<!\w)plus[\x20\t]+(?=[0-9])", re.I)


#: Before a local part that might be prose; and what such words stand before in prose.
_CUE = re.compile(r"(?<!\w)(?:e-?mail|mail|mailto|contact|kontakt|courriel|correo)(?:[\x20\t]*:[\x20\t]*|[\x20\t]+)$", re.I)
_NO_NAME = frozenset("me us them him her you it one all someone anyone address addresses form forms page pages details list server desk here".split())
_NTH = re.compile(r"[0-9]+(?:st|nd|rd|th)", re.I)
_ZONE = re.compile(r"\.[A-Za-z]{2,}$")


def _named(local: str, domain: str, before: str) -> bool:
    """Whether ``local at domain`` is an address: the local part has a letter and a dot, digit,
    underscore or hyphen inside, or a cue before it. No address are ordinals and names in capitals
    ("COVID-19 at who.int") unless the domain is in capitals too."""
    if not _ZONE.search(domain):
        return False
    if _CUE.search(before):
        return local.lower() not in _NO_NAME
    if not re.search("[._0-9-]", local.strip("-")) or not re.search("[A-Za-z]", local) or _NTH.fullmatch(local):
        return False
    return local != local.upper() or domain == domain.upper()


def _wide(c: str) -> str | None:
    """The ASCII form of a wide or other decimal character, or None."""
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and "!" <= folded <= "~" else None


_FOREIGN = re.compile(r"[^\x00-ɏ]|­")


class Tape:
    """A text and, for each of its characters, the source span it stands for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start = range(len(text))
        self.end = range(1, len(text) + 1)

    def rewrite(self, pieces: list[tuple[int, int, str]]) -> None:
        """Replace the spans, in order and apart, by the strings."""
        if not pieces:
            return
        text, start, end, at = [], [], [], 0
        for a, b, put in [*pieces, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:a])
            start.extend(self.start[at:a])
            end.extend(self.end[at:a])
            if a < b:
                text.append(put)
                start.extend([self.start[a]] * len(put))
                end.extend([self.end[b - 1]] * len(put))
            at = b
        self.text, self.start, self.end = "".join(text), start, end


def fold_letters(tape: Tape) -> None:
    """Wide forms always; look-alikes only in a word that also has ASCII letters, digits or an @."""
    pieces = []
    for token in re.finditer(r"\S+", tape.text) if _FOREIGN.search(tape.text) else ():
        if not _FOREIGN.search(token.group()):
            continue
        plain = re.search("[A-Za-z0-9@]", token.group()) or any(_wide(c) for c in token.group())
        for i, c in enumerate(token.group(), token.start()):
            if c in NO_WIDTH:
                pieces.append((i, i + 1, ""))
            elif c > "ɏ":
                put = (LOOKALIKES.get(c) if plain else None) or _wide(c)
                if put:
                    pieces.append((i, i + 1, put))
    tape.rewrite(pieces)


def read_digits(tape: Tape) -> None:
    """Runs of spelled digits become digits without gaps."""
    pieces = []
    for run in _DIGIT_RUN.finditer(tape.text):
        words = list(_ONE_DIGIT.finditer(tape.text, run.start(), run.end()))
        if len(words) < SPELLED_RUN and not (words and re.match(rf"[\x20\t]*(?:{_DOT})[\x20\t]", tape.text[words[-1].end() : words[-1].end() + 12], re.I)):
            near = tape.text[max(0, run.start() - 8) : run.start()]
            if not (words and re.search(rf"(?:^|\s)(?:{_DOT}|plus)[\x20\t]+$", near, re.I)):
                continue
        for i, w in enumerate(words):  # the gap before a digit goes with it
            pieces.append((words[i - 1].end() if i else w.start(), w.end(), SPELLED[w.group().lower()]))
    tape.rewrite(pieces)


def read_signs(tape: Tape) -> None:
    """At and dot in brackets; in words where they stand in an address; dot and plus by digits."""
    tape.rewrite([(*m.span(), "@") for m in _BRACKET_AT.finditer(tape.text)])
    tape.rewrite([(*m.span(), ".") for m in _BRACKET_DOT.finditer(tape.text)])
    pieces = []
    for m in _SAID.finditer(tape.text):
        spaced = list(_SPACED.finditer(tape.text, m.start(), m.end()))
        ats = [s for s in spaced if re.fullmatch(rf"\s+(?:{_AT})\s+", s.group(), re.I)]
        # With a spoken dot it is an address; "at" alone between words with a full stop may be prose.
        named = len(spaced) == 1 and ats and _named(tape.text[m.start() : m.start("at")], tape.text[m.end("at") : m.end()], tape.text[max(0, m.start() - 16) : m.start()])
        if named or len(spaced) > len(ats) and len(ats) <= 1:
            pieces += [(*s.span(), "@" if re.fullmatch(rf"\s+(?:{_AT})\s+", s.group(), re.I) else ".") for s in spaced]
    tape.rewrite(pieces)
    tape.rewrite([(*m.span(), ".") for m in _SAID_DOT.finditer(tape.text)])
    tape.rewrite([(*m.span(), "+") for m in _SAID_PLUS.finditer(tape.text)])


TRANSDUCERS = (fold_letters, read_digits, read_signs)
#: Without any of these no transducer rewrites anything.
_HINT = re.compile(rf"[^\x00-ɏ]|­|{_OPEN}[\x20\t]*(?:{_AT}|@|a|\.|{_DOT})[\x20\t]*{_CLOSE}|(?<!\w)(?:{_DOT}|plus)(?!\w)|[\x20\t](?:{_AT})[\x20\t]+{_LABEL}\.[A-Za-z0-9]", re.I)
_SIGNS = re.compile(rf"[\[({{<]|(?<!\w)(?:{_DOT}|plus)(?!\w)", re.I)
_THREE = re.compile(rf"(?<!\w){_WORD_DIGIT}[\x20\t]*+[-,]?+[\x20\t]*+{_WORD_DIGIT}(?!\w)", re.I)


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The plain spans and the added ones, each in order of start, then kind."""
    base = {kind: list(finder(text)) for kind, finder in FINDERS.items()}
    added = []
    if _HINT.search(text) or _THREE.search(text):
        tape = Tape(text)
        for step in TRANSDUCERS:
            step(tape)
        for kind, finder in FINDERS.items() if tape.text != text else ():
            taken = base[kind]
            for a, b in finder(tape.text):
                start, end = tape.start[a], tape.end[b - 1]
                if tape.text[a:b] != text[start:end] and not any(x < end and start < y for x, y in taken):
                    added.append((kind, start, end))
    order = lambda s: (s[1], KINDS.index(s[0]))
    return sorted(((k, a, b) for k, spans in base.items() for a, b in spans), key=order), sorted(added, key=order)


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
_FOUND = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            base, added = find(text or "")
            every = sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
            counts = {f"n_{k}": sum(s[0] == k for s in base) for k in KINDS}
            sha = hashlib.sha256(listed(base).encode()).hexdigest()
            rows.append({"doc_id": doc_id, **counts, "base_sha256": sha, "spans": listed(every), "n_added": len(added)})
        yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)


def detect(docs: DataFrame) -> DataFrame:
    """Per document the counts of plain finds, their digest and all spans."""
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(_rows, FOUND)


def masked(text: str) -> str:
    """The text with every span replaced by its kind; spans that overlap by the first one's."""
    base, added = find(text)
    out, at = [], 0
    for kind, a, b in sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The rows with personal data masked in ``text``; other columns as they are."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = pa.array([None if t is None else masked(t) for t in batch.column(at).to_pylist()], pa.string())
            yield batch.set_column(at, "text", texts)

    return docs.select(*columns).mapInArrow(run, docs.schema)


query = detect
