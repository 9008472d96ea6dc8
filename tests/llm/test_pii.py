"""Personal data against the plain patterns, disguises in four languages, and long texts made to be slow."""

import hashlib
import re
import time

import numpy as np
import pytest

from runloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_spans(text):
    out = {}
    for kind, pattern in PLAIN.items():
        found = list(re.finditer(pattern, text))
        digits = [re.sub("[^0-9]", "", m[0]) for m in found]
        good = {
            "email": lambda m, d: True, "ip": lambda m, d: all(int(p) <= 255 for p in m[0].split(".")),
            "card": lambda m, d: 13 <= len(d) <= 19 and luhn(d), "phone": lambda m, d: 9 <= len(d) <= 15}[kind]
        out[kind] = [m.span() for m, d in zip(found, digits, strict=True) if good(m, d)]
    return out


def test_base_spans_are_those_of_the_patterns():
    draw = np.random.default_rng(5)
    pieces = ["a", "b-c", "@", "@x.y", ".", "1", "25", "256", "10.0.0.1", "4111 1111 1111 1111", "4111111111111111", "+49 30 1234567", " ", "-", "+", "(", ")", "_", "é"]
    for _ in range(4000):
        text = "".join(draw.choice(pieces, draw.integers(1, 25)))
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("text, kind, span", [
    ("write joe [at] site [dot] org.", "email", "joe [at] site [dot] org"),
    ("write JOE (AT) SITE (DOT) ORG.", "email", "JOE (AT) SITE (DOT) ORG"),
    ("Hans (ät) web (punkt) de", "email", "Hans (ät) web (punkt) de"),
    ("jean arobase poste point fr", "email", "jean arobase poste point fr"),
    ("juan arroba correo punto es!", "email", "juan arroba correo punto es"),
    ("аеѕ@site.org x", "email", "аеѕ@site.org"),
    ("x j​o​e@si​te.org", "email", "j​o​e@si​te.org"),
    ("joe＠site．org", "email", "joe＠site．org"),
    ("𝐣𝐨𝐞@site.org", "email", "𝐣𝐨𝐞@site.org"),
    ("İ then joe [at] site [dot] org", "email", "joe [at] site [dot] org"),
    ("host 10 dot 0 dot 0 dot 1 up", "ip", "10 dot 0 dot 0 dot 1"),
    ("call plus four nine three zero one two three four five six seven.", "phone", "plus four nine three zero one two three four five six seven"),
    ("ruf plus vier neun drei null eins zwei drei vier fünf sechs an", "phone", "plus vier neun drei null eins zwei drei vier fünf sechs"),
    ("tel plus trois trois un deux trois quatre cinq six sept huit", "phone", "plus trois trois un deux trois quatre cinq six sept huit"),
    ("más tres cuatro cinco seis siete ocho nueve uno dos tres", "phone", "más tres cuatro cinco seis siete ocho nueve uno dos tres"),
    ("tel +٤٩ ٣٠ ١٢٣٤٥٦٧", "phone", "+٤٩ ٣٠ ١٢٣٤٥٦٧"),
    ("card four one-one-one 1111 1111 1111", "card", "four one-one-one 1111 1111 1111"),
])
def test_disguises(text, kind, span):
    base, every = pii.find(text)
    start = text.index(span)
    assert not base[kind] and every[kind] == [(start, start + len(span))]


@pytest.mark.parametrize("text", [
    None, "", "one or two of three, plus four more at nine", "ce point est un point", "el punto y la coma", "look at this there", "m² and x³", "рост и сорт"])
def test_clean_texts_have_no_spans(text):
    assert not any(pii.find(text)[1].values())


def test_base_spans_stay_beside_disguised_ones():
    text = "a@b.org and joe [at] site [dot] org and c@d.org"
    base, every = pii.find(text)
    assert [text[slice(*s)] for s in every["email"]] == ["a@b.org", "joe [at] site [dot] org", "c@d.org"] and len(base["email"]) == 2


@pytest.mark.parametrize("unit, tail", [
    ("[", " "), ("one", " "), ("plus", " "), ("a", " "), ("a at b", " "), ("+1", "("), ("", "[ "), ("", "one "), ("", "a at "), ("", "1."), ("", "a@"),
    ("", "[at] "), ("", "​"), ("", "а"), ("a at ", "b"), ("", "1"), ("", "- "), ("a@", "b-")])
def test_long_texts_are_scanned_in_linear_time(unit, tail):
    text = unit + tail * (400_000 // len(tail))
    start = time.process_time()
    pii.find(text)
    assert time.process_time() - start < 4


def test_rows(spark):
    rows = [(1, "a@b.org", "x"), (None, "a@b.org", "x"), (1, "joe [at] site [dot] org", "x"), (2, None, None), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.pii_spans(docs).collect()
    assert sorted(r["spans"] for r in got) == ["", "", "email:0:23", "email:0:7", "email:0:7"]
    assert {r["base_sha256"] for r in got if r["doc_id"] in (2, 3)} == {hashlib.sha256(b"").hexdigest()}
    assert pii.pii_spans(docs.limit(0)).count() == 0
