"""Personal data: plain patterns, plus offset-preserving deobfuscation of disguised ones.

Plain patterns (email, ip, card, phone) run on the text itself, leftmost and non-overlapping per kind; a match that fails its check is
dropped. For disguised identifiers two transducers rewrite the text while they keep, for each character they emit, the source
characters it stands for: the first folds homoglyphs and drops invisible characters, the second reads spelled digits and
``[at]``/``(dot)``/`` dot `` as the signs they stand for. The same patterns then run on the normalised text, and each
span that covers a rewritten character is mapped back to the source. A mapped span that overlaps a plain span of any kind
is left out: plain spans stay as they are.

Defined results: a NULL text counts as empty and has no spans. Texts are read whole, in time linear in their length. The transducers go
through a long text in overlapping pieces, so their memory has a bound; a disguised identifier of over 4,096 characters may be
missed there. Offsets are code points, ends exclusive. Equal rows give equal rows; columns other than id and text are never looked at.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.llm.common import blocks, ship_package

KINDS = ("email", "ip", "card", "phone")
#: Characters that the transducers rewrite at once, and how many on both sides a disguised identifier may reach beyond them.
PIECE, AROUND = 1 << 17, 1 << 12

# Characters of an email's local part.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """From each ``@`` to both sides: a local part must end right before it, so no other start can match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start, step = at, 64
        while start > done:  # grow the part that is looked at, so that a long word is read once
            low = max(done, start - step)
            left = len(text[low:start].rstrip(_LOCAL))
            start = low + left
            if left:
                break
            step *= 2
        end = at
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = end = m.end()
        at = text.find("@", max(end, at + 1))
    return out


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all plain matches, sorted."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


# Characters of other scripts that look like Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "∙": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
}
# Invisible characters that are dropped.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Digits as words in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_ODD_CHARS = re.compile("[\u00ad\u0370-\uffff\U00010000-\U0010ffff]")
_DIGIT_WORD = "|".join(sorted(DIGIT_WORDS, key=lambda w: (-len(w), w)))
#: At least three digits in a row, the first as a word: fewer are ordinary prose.
_DIGIT_RUN = rf"(?<!\w)(?:{_DIGIT_WORD})(?:(?:[ \t]*[-,./][ \t]*|[ \t]+(?:dot|plus)[ \t]+|[ \t]+)(?:{_DIGIT_WORD}|[0-9])(?!\w)){{2,}}"
# Ends of domains after which a bare ``at`` ... ``dot`` ... is read as an address.
_ENDINGS = "com|org|net|edu|gov|info|biz|io|co|uk|de|fr|es|eu"
_BRACKETED = r"(?<![ \t])[ \t]*[\[({<][ \t]*(?P<sign>at|@|dot|\.)[ \t]*[\])}>][ \t]*"
_DOT = r"(?:[ \t]+dot[ \t]+|[ \t]*[\[({<][ \t]*(?:dot|\.)[ \t]*[\])}>][ \t]*)"
_WORDED = rf"(?<=[A-Za-z0-9])[ \t]+at[ \t]+(?=[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}(?:{_ENDINGS})(?!\w))"
_DOT_WORD = r"(?<=[A-Za-z0-9])[ \t]+dot[ \t]+(?=[A-Za-z0-9])"
_DISGUISE = re.compile(rf"(?P<br>{_BRACKETED})|(?P<at>{_WORDED})|(?P<dot>{_DOT_WORD})|(?P<digits>{_DIGIT_RUN})|(?P<plus>(?<!\w)plus[ \t]+(?=(?:{_DIGIT_WORD}|[0-9])))", re.I)
_DIGIT_PART = re.compile(rf"(?P<word>{_DIGIT_WORD})|(?P<digit>[0-9])|(?P<dot>[ \t]+dot[ \t]+)|(?P<plus>[ \t]+plus[ \t]+)|(?P<gap>[ \t]*[-,./][ \t]*|[ \t]+)", re.I)
#: Cheap necessary signs of a disguise of the second kind.
_HINT = re.compile(rf"[\[({{<][ \t]*(?:at|@|dot|\.)[ \t]*[\])}}>]|\bdot\b|(?<!\w)(?:{_DIGIT_WORD})[ \t,./-]+(?:{_DIGIT_WORD}|[0-9])(?!\w)|(?<!\w)plus[ \t]+(?:{_DIGIT_WORD}|[0-9])", re.I)

Mapped = tuple[str, list[int], list[int], list[bool]]


def fold_homoglyphs(text: str) -> Mapped:
    """The text with look-alikes folded; for each character its source's start and end, and whether it was rewritten."""
    out, start, end, new = [], [], [], []
    for i, c in enumerate(text):
        if c < "\u0370" and c != "\u00ad":
            to = c
        elif c in INVISIBLE:
            if new:
                new[-1] = True
                end[-1] = i + 1 if end[-1] == i else end[-1]
            continue
        else:
            to = HOMOGLYPHS.get(c) or unicodedata.normalize("NFKC", c)
            to = to if to.isascii() else c
        for x in to:
            out.append(x)
            start.append(i)
            end.append(i + 1)
            new.append(x != c)
    return "".join(out), start, end, new


def read_disguises(m: Mapped) -> Mapped:
    """The second transducer, after the first."""
    text, s, e, n = m
    out, start, end, new, at = [], [], [], [], 0

    def put(sign: str, a: int, b: int) -> None:
        out.append(sign)
        start.append(s[a])
        end.append(e[b - 1])
        new.append(True)

    for d in _DISGUISE.finditer(text):
        a, b = d.span()
        out.append(text[at:a])
        start += s[at:a]
        end += e[at:a]
        new += n[at:a]
        at = b
        if d["br"]:
            put("@" if d["sign"].lower() in ("at", "@") else ".", a, b)
        elif d["at"]:
            put("@", a, b)
        elif d["dot"]:
            put(".", a, b)
        elif d["plus"]:
            put("+", a, b)
        else:
            for p in _DIGIT_PART.finditer(text, a, b):
                if p["word"] or p["digit"]:
                    put(DIGIT_WORDS[p["word"].lower()] if p["word"] else p["digit"], *p.span())
                elif p["dot"] or p["plus"]:
                    put("." if p["dot"] else "+", *p.span())
                elif "." in p["gap"]:
                    put(".", *p.span())
    out.append(text[at:])
    return "".join(out), start + s[at:], end + e[at:], new + n[at:]


def _rewritten(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in the source of matches in the normalised text that cover a rewritten character."""
    odd = not text.isascii() and _ODD_CHARS.search(text)
    if not odd and not _HINT.search(text):
        return []
    m = fold_homoglyphs(text) if odd else (text, list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text))
    norm, start, end, new = read_disguises(m)
    return [(start[a], kind, end[b - 1]) for a, kind, b in plain_spans(norm) if any(new[a:b])]


def disguised_spans(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in the source of identifiers that only the normalised text shows, none of which overlaps a plain one."""
    found = []
    for at in range(0, len(text), PIECE):
        low = max(0, at - AROUND)
        found += [(x + low, kind, y + low) for x, kind, y in _rewritten(text[low : at + PIECE + AROUND]) if at <= x + low < at + PIECE]
    starts, last = [p[0] for p in plain], list(accumulate((p[2] for p in plain), max))
    return [s for s in found if not (k := bisect_left(starts, s[2])) or last[k - 1] <= s[0]]


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id, counts of plain matches and of added ones by kind, plain and all: the spans as ``kind:start:end``, by start and kind."""
    ship_package(docs.sparkSession)
    names = [id_col, *(f"n_{k}" for k in KINDS), "plain", "spans", *(f"n_added_{k}" for k in KINDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1):
            counts, base, every, more = [[] for _ in KINDS], [], [], [[] for _ in KINDS]
            for text in block.column(1).to_pylist():
                plain = plain_spans(text or "")
                added = disguised_spans(text or "", plain)
                for own, spans in ((counts, plain), (more, added)):
                    for k, c in enumerate(own):
                        c.append(sum(x[1] == k for x in spans))
                base.append(_told(plain))
                every.append(_told(sorted(plain + added)))
            numbers = lambda own: [pa.array(c, pa.int64()) for c in own]
            yield pa.RecordBatch.from_arrays([block.column(0), *numbers(counts), pa.array(base, pa.string()), pa.array(every, pa.string()), *numbers(more)], names)

    schema = docs.select(id_col).schema
    for n in names[1:]:
        schema = schema.add(n, "long" if n[:2] == "n_" else "string")
    return docs.select(id_col, F.col("text").alias("__text")).mapInArrow(run, schema)
