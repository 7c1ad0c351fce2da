"""Personal data in texts, disguised forms included, with spans in the original characters.

Plain identifiers are found by fixed patterns. Then a chain of transducers rewrites the text (look-alike characters,
spelled digits, at/dot disguises) and keeps, for each output character, the source range it came from; the same
patterns run over the rewritten text, and spans that touch a rewritten place are mapped back and added.

Defined results: a null or empty text has no spans (redacted() keeps a null one null); rows are kept one for one, repeated
ids included; a null id stays null; other columns are ignored by personal_data() and kept by redacted(), whatever their
names; texts are read whole; no rows give no rows. Spans are code points, end exclusive, ordered by start, then
kind in the order of KINDS, then end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clausewise.llm.common import slices

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns, with possessive repeats and look-behinds that leave the matches as they are.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TWO_DIGITS = re.compile(r"[0-9][\x20-]?[0-9]")

# Characters that look like Latin ones.
_LOOK_ALIKE = dict(
    zip(
        "аеорсухіјѕԁԛԝһӏАВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονρικυ‐‑‒–—―−․。．٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹",
        "aeopcyxijsdqwhlABEKMHOPCTYXIJSABEZHIKMNOPTYXaovpiku-------...01234567890123456789",
        strict=True,
    )
)
_LOOK_ALIKE |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width forms
_LOOK_ALIKE |= dict.fromkeys("           　", " ")
_DROPPED = "­​‌‍⁠﻿"
_TABLE = str.maketrans(_LOOK_ALIKE)
_ODD = re.compile("[" + re.escape("".join(_LOOK_ALIKE) + _DROPPED) + "]")
_DROP = re.compile(f"[{_DROPPED}]")

# Digits, "plus" and the dot as words in English, German, French and Spanish.
_DIGIT_WORDS = {
    "0": "zero oh null zéro cero", "1": "one eins ein un une uno", "2": "two zwei zwo deux dos", "3": "three drei trois tres",
    "4": "four vier quatre cuatro", "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete",
    "8": "eight acht huit ocho", "9": "nine neun neuf nueve", "+": "plus más", ".": "dot point punkt punto",
}
_DIGIT = {w: d for d, words in _DIGIT_WORDS.items() for w in words.split()}
_ONE = "|".join(sorted(_DIGIT, key=len, reverse=True))
#: Four or more digit words and numerals one after another; rewritten where there is a word among them.
_SPELLED = re.compile(rf"(?<!\w)(?:{_ONE}|[0-9]++)(?:[ \t\r\n,/-]{{1,3}}(?:{_ONE}|[0-9]++)(?!\w)){{3,}}(?!\w)", re.IGNORECASE)
_ITEM = re.compile(r"[^\W\d_]+|[0-9]+")

_AT = re.compile(r"\s*(?:\[\s*(?:at|@|arroba|chez)\s*\]|\(\s*(?:at|@|arroba|chez)\s*\)|\{\s*(?:at|@|arroba|chez)\s*\}|<\s*(?:at|@)\s*>)\s*", re.IGNORECASE)
_DOT = re.compile(r"\s*(?:\[\s*(?:dot|\.|punkt|point|punto)\s*\]|\(\s*(?:dot|\.|punkt|point|punto)\s*\)|\{\s*(?:dot|\.|punkt|point|punto)\s*\}|<\s*(?:dot|\.)\s*>)\s*", re.IGNORECASE)
_BRACKET = re.compile(r"[\[({<]\s*(?:at|@|arroba|chez|dot|\.|punkt|point|punto)\s*[\])}>]", re.IGNORECASE)
#: Unbracketed forms count only as a whole: a name, a word for "@" (or the sign), and labels of which two at least are
#: joined by a word for the dot in the same language; the last label has two letters or more.
_AT_WORD = re.compile(r"[ \t\r\n]{1,3}(?P<word>at|arroba|arobase|@)[ \t\r\n]{1,3}|(?P<sign>@)", re.IGNORECASE)
_DOTS = {"at": "dot|punkt", "arroba": "punto|dot", "arobase": "point|dot", "@": "dot|punkt|punto|point"}
_JOINT = {at: rf"(?:[ \t\r\n]{{1,3}}(?:{dots})[ \t\r\n]{{1,3}})" for at, dots in _DOTS.items()}
_SPOKEN_DOT = {at: re.compile(joint, re.IGNORECASE) for at, joint in _JOINT.items()}
_SPOKEN_DOMAIN = {at: re.compile(rf"[A-Za-z0-9-]++(?:(?:{joint}|\.)[A-Za-z0-9-]++)*(?:{joint}|\.)[A-Za-z]{{2,}}(?![A-Za-z0-9-])", re.IGNORECASE) for at, joint in _JOINT.items()}
_SPOKEN_NAME = {at: re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:(?:{joint}|\.)[A-Za-z0-9_%+-]++)*+", re.IGNORECASE) for at, joint in _JOINT.items()}
_DOT_WORD = re.compile(r"[ \t\r\n](?:dot|punkt|punto|point)[ \t\r\n]", re.IGNORECASE)

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain(text: str) -> list[Span]:
    """The identifiers that the patterns find, leftmost and non-overlapping per kind; failing matches are dropped."""
    found: list[Span] = []
    if "@" in text:
        over = 0
        for m in _DOMAIN.finditer(text):
            begin = m.start()
            while begin > over and (text[begin - 1].isascii() and text[begin - 1].isalnum() or text[begin - 1] in "._%+-"):
                begin -= 1
            if begin < m.start():
                found.append((begin, 0, m.end()))
                over = m.end()
    if _TWO_DIGITS.search(text) is not None or "." in text:
        for m in _IP.finditer(text):
            if all(int(p) <= 255 for p in m[0].split(".") if len(p) < 4000) and all(len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
    if _TWO_DIGITS.search(text) is not None:
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


class Rewritten:
    """A text under rewriting; begins and ends give the source range of each of its characters, None: itself."""

    def __init__(self, text: str):
        self.text, self.begins, self.ends, self.edited = text, None, None, None

    def _track(self) -> None:
        if self.begins is None:
            self.begins = np.arange(len(self.text))
            self.ends = self.begins + 1
            self.edited = np.zeros(len(self.text), bool)

    def look_alikes(self) -> None:
        if self.text.isascii() or not _ODD.search(self.text):
            return
        self._track()
        for m in _ODD.finditer(self.text):
            self.edited[m.start()] = True
        drop = np.fromiter((m.start() for m in _DROP.finditer(self.text)), np.int64)
        if len(drop):  # a dropped character marks its neighbours as edited
            self.edited[np.minimum(drop + 1, len(self.text) - 1)] = True
            keep = np.ones(len(self.text), bool)
            keep[drop] = False
            self.begins, self.ends, self.edited = self.begins[keep], self.ends[keep], self.edited[keep]
            self.text = _DROP.sub("", self.text)
        self.text = self.text.translate(_TABLE)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put strings in place of ranges, which are ordered and disjoint; each new character maps to its whole range."""
        if not edits:
            return
        self._track()
        text, begins, ends, edited, at = [], [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text += [self.text[at:a], new]
            begins += [self.begins[at:a], np.full(len(new), self.begins[a] if a < len(self.begins) else 0)]
            ends += [self.ends[at:a], np.full(len(new), self.ends[b - 1] if b else 0)]
            edited += [self.edited[at:a], np.ones(len(new), bool)]
            at = b
        self.text, self.begins, self.ends, self.edited = "".join(text), np.concatenate(begins), np.concatenate(ends), np.concatenate(edited)

    def spelled_digits(self) -> None:
        edits = []
        for m in _SPELLED.finditer(self.text):
            # each word maps to its own range, and what separates two items goes with the first, but between numerals it stays
            items = list(_ITEM.finditer(m[0]))
            if all(w[0].isdigit() for w in items):
                continue
            for i, w in enumerate(items):
                begin, end = m.start() + w.start(), m.start() + w.end()
                then = m.start() + items[i + 1].start() if i + 1 < len(items) else end
                if not w[0].isdigit():
                    edits.append((begin, then, _DIGIT[w[0].lower()]))
                elif i + 1 < len(items) and not items[i + 1][0].isdigit():
                    edits.append((end, then, ""))
        self.replace(edits)

    def disguises(self) -> None:
        if _BRACKET.search(self.text):
            self.replace([(m.start(), m.end(), "@") for m in _AT.finditer(self.text)])
            self.replace([(m.start(), m.end(), ".") for m in _DOT.finditer(self.text)])
        if _DOT_WORD.search(self.text):
            edits, over = [], 0
            for m in _AT_WORD.finditer(self.text):
                at = (m["word"] or "@").lower()
                domain = _SPOKEN_DOMAIN[at].match(self.text, m.end())
                if domain is None or not _SPOKEN_DOT[at].search(domain[0]):
                    continue
                name = None
                for name in _SPOKEN_NAME[at].finditer(self.text, over, m.start()):
                    pass
                over = m.start()
                if name is None or name.end() != m.start():
                    continue
                dots = [*_SPOKEN_DOT[at].finditer(self.text, *name.span()), *_SPOKEN_DOT[at].finditer(self.text, *domain.span())]
                edits += [(d.start(), d.end(), ".") for d in dots] + [(m.start(), m.end(), "@")]
                over = domain.end()
            self.replace(sorted(edits))


def rewritten_spans(text: str) -> list[Span]:
    """The identifiers that show only after rewriting, in source characters."""
    out = Rewritten(text)
    out.look_alikes()
    out.spelled_digits()
    out.disguises()
    if out.begins is None:
        return []
    found = []
    for a, kind, b in plain(out.text):
        if out.edited[a:b].any():
            begin, end = int(out.begins[a]), int(out.ends[b - 1])
            while end > begin and text[end - 1] in " \t,/-":
                end -= 1
            found.append((begin, kind, end))
    return found


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans with those of disguised identifiers."""
    base = plain(text)
    more = rewritten_spans(text)
    return base, sorted({*base, *more}) if more else base


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Each maximal run of overlapping spans becomes the name of its first kind in brackets."""
    out, at = [], 0
    i = 0
    while i < len(spans):
        a, kind, b = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < b:
            i += 1
            b = max(b, spans[i][2])
        out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = b
        i += 1
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans): plain counts and digest, and all spans. One scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text in slices(batches):
            counts, digests, spans = np.zeros((len(KINDS), rows.num_rows), np.int64), [], []
            for i, t in enumerate(text.to_pylist()):
                base, every = find(t)
                for _, kind, _ in base:
                    counts[kind, i] += 1
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
            yield pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(docs[id_col], docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs, personal data in the text replaced by its kind; a null text stays null. One scan."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text in slices(batches, text_col):
            null = rows.column(place).is_null().to_pylist()
            new = [None if gone else redact(t, find(t)[1]) for t, gone in zip(text.to_pylist(), null, strict=True)]
            yield rows.set_column(place, rows.schema.field(place).with_type(pa.string()), pa.array(new, pa.string()))

    return docs.mapInArrow(run, docs.schema)
