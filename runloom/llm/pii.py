"""Personal data with source offsets: base patterns on the text, then on a deobfuscated copy of it.

Two transducers run one after the other. The first rewrites single characters: look-alikes, other
forms of ASCII characters and of digits, characters without width. The second rewrites words:
spelled digits, "plus", and disguised "at" and "dot" in English, German, French and Spanish. Each
writes a `Tape`, which maps ranges of its output to ranges of its input, so that identifiers found
in the last output are reported as ranges of the source. Both read a text once from left to right:
white space is taken possessively or from one side only, so no pattern returns to it.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from runloom.llm.common import table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Look-alike letters and the plain letter each stands for.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "κ": "k", "ı": "i", "ɡ": "g", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
# Spelled digits in English, German, French and Spanish.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Words for "@", "." and "+" in the four languages.
AT_WORDS = "arrobase arobase arobas arroba klammeraffe at ät".split()
DOT_WORDS = "punkt point punto dot".split()
PLUS_WORDS = "plus más".split()


def _any(words) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


# Patterns for text in lower case.
_AT, _DOT, _DIGIT = _any(AT_WORDS), _any(DOT_WORDS), _any(DIGITS)
_BOXED = re.compile(rf"[\[({{<]\s*+(?:(?P<at>@|{_AT})|(?P<dot>\.|{_DOT}))\s*+[\])}}>]")
_BOXED_DOT = rf"\s*+[\[({{<]\s*+(?:\.|{_DOT})\s*+[\])}}>]"
_SPACED = re.compile(
    rf"(?<=[a-z0-9])\s++(?:(?P<at>@|{_AT})\s++(?=[a-z0-9-]++(?:{_BOXED_DOT}|\s++{_DOT}\s|\.[a-z]))|(?P<dot>{_DOT})\s++(?=[a-z0-9]))")
_ONE = rf"(?:{_DIGIT}\b|[0-9]++)"
_SPELLED = re.compile(rf"\b(?:(?P<plus>{_any(PLUS_WORDS)})\s++(?={_ONE})|{_DIGIT}\b(?:[\s-]++{_ONE})++)")
_STEP = re.compile(_ONE)


def emails(text: str) -> list[tuple[int, int]]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    return found


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out = {"email": emails(text), "ip": [], "card": [], "phone": []}
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out["phone"].append(m.span())
    return out


def _plain(char: str) -> str:
    """ASCII character that a character stands for, nothing for one without width, or the character itself."""
    if char in HOMOGLYPHS:
        return HOMOGLYPHS[char]
    if unicodedata.category(char) == "Cf":
        return ""
    if unicodedata.category(char) == "Nd":
        return str(unicodedata.decimal(char))
    form = unicodedata.decomposition(char)
    if form.startswith("<") and not form.startswith(("<super>", "<sub>", "<noBreak>")):
        other = unicodedata.normalize("NFKC", char)
        if len(other) == 1 and "!" <= other <= "~":
            return other
    return char


class Tape:
    """Output of a transducer: its text, and the source range of any range of it.

    Edits are (start, end, output) in order of start; one that begins inside another is left out.
    """

    def __init__(self, text: str, edits: list[tuple[int, int, str]]) -> None:
        parts: list[str] = []
        #: Pieces in order: place in the output, source start, source end, copied as it is.
        self.at: list[int] = []
        self.source: list[tuple[int, int, bool]] = []
        done = size = 0
        for start, end, out in edits:
            if start < done:
                continue
            for piece, a, b, same in ((text[done:start], done, start, True), (out, start, end, False)):
                if piece:
                    self.at.append(size)
                    self.source.append((a, b, same))
                    parts.append(piece)
                    size += len(piece)
            done = end
        if done < len(text):
            self.at.append(size)
            self.source.append((done, len(text), True))
            parts.append(text[done:])
        self.text = "".join(parts)

    def range(self, start: int, end: int) -> tuple[int, int]:
        """Source range of the output range [start, end), which is not empty."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        first, last = self.source[i], self.source[j]
        return (first[0] + start - self.at[i] if first[2] else first[0]), (last[0] + end - self.at[j] if last[2] else last[1])


class Characters(dict):
    """Code point to plain form, filled as characters are met; unchanged characters map to themselves."""

    def __missing__(self, code: int) -> str:
        self[code] = _plain(chr(code))
        return self[code]


_CHARACTERS = Characters()


def fold_characters(text: str) -> Tape | None:
    """First transducer; None if no character changes."""
    if text.isascii():
        return None
    odd = {c: _CHARACTERS[ord(c)] for c in set(text) if not c.isascii() and _CHARACTERS[ord(c)] != c}
    if not odd:
        return None
    gone = "".join(re.escape(c) for c, plain in odd.items() if not plain)
    tape = Tape(text, [(*m.span(), "") for m in re.finditer(f"[{gone}]+", text)] if gone else [])
    tape.text = tape.text.translate(str.maketrans(odd))
    return tape


def fold_words(text: str) -> Tape | None:
    """Second transducer; None if no word changes."""
    low = text.replace("İ", "I").lower()  # the one character whose lower case is longer
    edits = []
    done = 0
    for m in _BOXED.finditer(low):
        start, end = m.span()
        while start > done and text[start - 1].isspace():
            start -= 1
        while end < len(text) and text[end].isspace():
            end += 1
        edits.append((start, end, "@" if m["at"] else "."))
        done = end
    edits += [(*m.span(), "@" if m["at"] else ".") for m in _SPACED.finditer(low)]
    for m in _SPELLED.finditer(low):
        if m["plus"]:
            edits.append((*m.span(), "+"))
            continue
        steps = [one.span() for one in _STEP.finditer(low, *m.span())]
        edits += [(start, after, DIGITS.get(low[start:end], text[start:end]))
                  for (start, end), after in zip(steps, [*[start for start, _ in steps[1:]], m.end()], strict=True)]
    return Tape(text, sorted(edits)) if edits else None


def find(text: str | None) -> tuple[dict, dict]:
    """Base spans and all spans by kind; a null text counts as empty."""
    text = text or ""
    base = base_spans(text)
    every = {k: list(v) for k, v in base.items()}
    tapes = []
    plain = text
    for step in (fold_characters, fold_words):
        if tape := step(plain):
            tapes.insert(0, tape)
            plain = tape.text
    if not tapes:
        return base, every
    for kind, spans in base_spans(plain).items():
        starts = [s for s, _ in base[kind]]
        for a, b in spans:
            found = plain[a:b]
            for tape in tapes:
                a, b = tape.range(a, b)
            while b > a and text[b - 1].isspace():
                b -= 1
            i = bisect_right(starts, a)
            if found != text[a:b] and (not i or base[kind][i - 1][1] <= a) and (i == len(starts) or starts[i] >= b):
                every[kind].append((a, b))
        every[kind].sort()
    return base, every


def _joined(spans: dict) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k])


def pii_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: identifier, counts by kind of all spans, base digest and all spans.

    Null and empty texts give no spans and the digest of the empty string; repeated rows are each
    reported; other columns are not read, whatever their names; an empty table gives no rows. Long
    texts are scanned whole in linear time. Offsets are code points of the source, end exclusive.
    n_email to n_phone count all spans, n_base the base spans alone. Spans of the rewritten text that
    touch a base span of their kind are left out.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                base, every = find(text)
                rows.append((key, *(len(every[k]) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(),
                             _joined(every), sum(map(len, base.values()))))
            yield pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_base"])

    return docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text")).mapInPandas(
        scan, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_base long")


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii_spans(table(spark, folder, "documents"))
