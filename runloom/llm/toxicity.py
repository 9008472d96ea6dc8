"""Toxicity from a weighted lexicon: folded text, one Aho-Corasick pass, sums over the length, exception phrases.

Texts are folded first: compatibility forms, case, look-alike letters of other scripts, invisible characters,
and digits or signs that stand for letters inside a word.  The lexicon holds word beginnings and whole words
whose rate in toxic texts is far above their rate in others, weighted by the logarithm of that ratio.  Phrases
of two words that hold an entry but are usual in clean texts are exceptions and hide the entries inside.  At
each word the longest entry counts.  The sum of weights, alone and by length, and the number of different
entries go through a logistic curve.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.common import stored, table

# Look-alike letters of Cyrillic and Greek, and digits and signs used as letters.
_LOOKALIKES = dict(zip("авекмнорстухіјѕԁԛԝαβεικνορτυχ", "abekmhopctyxijsdqwabeikvoptux"))
_LEET = str.maketrans("013457@$", "oieastas")
_INVISIBLE = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
_FOLD = {**{ord(a): b for a, b in _LOOKALIKES.items()}, **_INVISIBLE}
_SIGNS = re.compile(r"(?<=[^\W\d_])[0-9@$]++|(?<![0-9@$])[0-9@$]++(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
SHORTEST, LONGEST = 3, 12


def fold(text: str | None) -> str:
    """Folded words between single blanks, with a blank at both ends."""
    if not text:
        return " "
    text = unicodedata.normalize("NFKC", text).casefold().translate(_FOLD)
    text = _SIGNS.sub(lambda m: m[0].translate(_LEET), text)
    return " " + "".join(w + " " for w in _WORD.findall(text))


def patterns_of(word: str) -> list[str]:
    """Beginnings of a word, and the word as a whole; all start at the blank before it."""
    cuts = range(SHORTEST, min(len(word), LONGEST) + 1)
    return [f" {word} ", *(" " + word[:n] for n in cuts)]


@dataclass
class Model:
    """Entries with weights, exception phrases, and the logistic curve over the features of `features`."""

    entries: Mapping[str, float]
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0)
    machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return (dict(self.entries), self.exceptions, self.curve)

    def __setstate__(self, state):
        self.entries, self.exceptions, self.curve = state
        self.machine = None

    def hits(self, folded: str) -> list[tuple[int, str]]:
        """Start and entry of the longest entry at each word outside of the exception phrases."""
        if self.machine is None:
            self.machine = ahocorasick.Automaton()
            for p in self.exceptions:
                self.machine.add_word(p, (p, False))
            for p in self.entries:
                if p not in self.exceptions:
                    self.machine.add_word(p, (p, True))
            if len(self.machine):
                self.machine.make_automaton()
        if not len(self.machine):
            return []
        best: dict[int, str] = {}
        spared: list[tuple[int, int]] = []
        for end, (p, entry) in self.machine.iter(folded):
            start = end + 1 - len(p)
            if not entry:
                spared.append((start, end))
            elif len(p) > len(best.get(start, "")):
                best[start] = p
        found = sorted(best.items())
        if not spared:
            return found
        spared.sort()
        out, at, reach = [], 0, -1
        for start, p in found:
            while at < len(spared) and spared[at][0] <= start:
                reach = max(reach, spared[at][1])
                at += 1
            if start + len(p) - 1 > reach:
                out.append((start, p))
        return out

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        folded = fold(text)
        return self._features(folded, [p for _, p in self.hits(folded)])

    def _features(self, folded: str, found: list[str]) -> tuple[float, float, float, float]:
        words = folded.count(" ") - 1
        total = sum(self.entries[p] for p in found)
        return (1.0, math.log1p(total), math.log1p(100 * total / (words + 10)), math.log1p(len(set(found))))

    def assess(self, text: str | None) -> tuple[float, list[str]]:
        """Score, and the entries found, in order."""
        folded = fold(text)
        found = [p for _, p in self.hits(folded)]
        z = sum(a * b for a, b in zip(self.curve, self._features(folded, found)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), [p.strip() for p in found]


# --- learning ---------------------------------------------------------------------------------
def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, toxic and half (0 or 1) of at most `sample` labelled documents of either label.

    Documents are drawn by a hash of doc_id from the labels alone, so no text is moved for it; a document
    with several labels counts as toxic if one says so, and copies of a text count once.
    """
    marks = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")).withColumn("_h", F.xxhash64("doc_id"))
    drawn = [marks.where(F.col("toxic") == y).orderBy("_h", "doc_id").limit(sample) for y in (0, 1)]
    drawn = F.broadcast(drawn[0].unionByName(drawn[1]).drop("_h"))  # at most 2 x sample rows of two numbers
    texts = docs.select("doc_id", "text").join(drawn, "doc_id").where("text IS NOT NULL")
    texts = texts.groupBy("text").agg(F.max("toxic").alias("toxic"))
    return texts.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))


def _counted(frames: Iterator[pd.DataFrame], terms) -> Iterator[pd.DataFrame]:
    """Per term and class: documents and occurrences; tables of a task are passed on before they grow large."""
    counts: dict[str, np.ndarray] = {}

    def table_of():
        return pd.DataFrame([(t, *map(float, v)) for t, v in counts.items()], columns=["term", *COUNTS])

    for frame in frames:
        for text, toxic, half in zip(frame["text"], frame["toxic"], frame["half"]):
            at = 4 * int(half) + 2 * int(toxic)
            for term, n in terms(text).items():
                row = counts.get(term)
                if row is None:
                    row = counts[term] = np.zeros(8)
                row[at] += 1
                row[at + 1] += n
            if len(counts) > 200_000:
                yield table_of()
                counts.clear()
    if counts:
        yield table_of()


#: Documents and occurrences, by half and label.
COUNTS = ["d00", "o00", "d01", "o01", "d10", "o10", "d11", "o11"]


def _count(sample: DataFrame, terms) -> DataFrame:
    shape = "term string, " + ", ".join(f"{c} double" for c in COUNTS)
    counted = sample.mapInPandas(lambda frames: _counted(frames, terms), shape)
    return counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _word_terms(text: str) -> Counter:
    words = Counter(_WORD.findall(fold(text)))
    out: Counter = Counter({"": sum(words.values())})
    for word, n in words.items():
        for p in patterns_of(word):
            out[p] += n
    return out


def entries_of(counts: pd.DataFrame, halves: Iterable[int], least: int, ratio: float, surprise: float) -> dict[str, float]:
    """Weights of the terms that are in `least` toxic documents, `ratio` times as frequent as in clean ones, and surely so.

    Sure means that the G statistic of the document counts is above `surprise`.  Of beginnings that occur
    equally often the longest one stays, so that entries hold no more words than those seen; a whole word
    that occurs as often as the beginning of its letters is left out.
    """
    def total(c, y):
        return sum(counts[f"{c}{h}{y}"] for h in halves).to_numpy()

    d0, d1, o0, o1 = total("d", 0), total("d", 1), total("o", 0), total("o", 1)
    whole = counts["term"].to_numpy() == ""
    if not whole.any():
        return {}
    n0, n1, w0, w1 = (float(x[whole][0]) for x in (d0, d1, o0, o1))
    if not (n1 and n0):
        return {}

    def part(k, n, p):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / (n * p)), 0.0)

    p = (d0 + d1) / (n0 + n1)
    g = 2 * (part(d0, n0, p) + part(d1, n1, p) + part(n0 - d0, n0, 1 - p) + part(n1 - d1, n1, 1 - p))
    weight = np.log((o1 + 0.5) / (w1 + 1)) - np.log((o0 + 0.5) / (w0 + 1))
    good = ~whole & (d1 >= least) & (weight >= math.log(ratio)) & (g >= surprise)
    kept = {t: (w, k1, k0) for t, w, k1, k0 in zip(counts["term"][good], weight[good], o1[good], o0[good])}
    same = set()
    for t, (_, k1, k0) in kept.items():
        for n in range(SHORTEST + 1, len(t)):
            if kept.get(t[:n], (0, -1, -1))[1:] == (k1, k0):
                same.add(t if t.endswith(" ") else t[:n])
    return {t: float(w) for t, (w, _, _) in kept.items() if t not in same}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; both labels weigh alike up to the square root of their share."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = ridge * w
        pull[0] = 0.0
        grad = x.T @ (p - y) + pull
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _phrases(frames, entries: dict[str, float]):
    model = Model(entries)

    def terms(text):
        folded = fold(text)
        out: Counter = Counter({"": 1})
        for start, _ in model.hits(folded):
            end = folded.index(" ", start + 1)
            if start > 0:
                out[folded[folded.rindex(" ", 0, start):end + 1]] += 1
            if end + 1 < len(folded):
                out[folded[start:folded.index(" ", end + 1) + 1]] += 1
        return out

    return _counted(frames, terms)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, most: int = 20_000, least: int = 3, ratio: float = 3.0,
        surprise: float = 12.0, spared: int = 5) -> Model:
    """Model from labelled documents; `sample` bounds them per label, `most` the terms and phrases that reach the driver.

    The curve is fitted on features that come from the lexicon of the other half of the sample, so that
    entries which fit only the texts they were found in do not look better than they are.  Without both
    labels the lexicon is empty and the score is the share of toxic rows.
    """
    texts = stored(labelled_sample(docs, labels, sample), "toxic-sample")
    counts = _count(texts, _word_terms)
    toxic = F.col("d01") + F.col("d11")
    clean = F.col("d00") + F.col("d10")
    rows = counts.where((F.col("term") == "") | (toxic >= least)).orderBy(
        F.col("term") != "", (toxic * toxic / (toxic + clean + 1)).desc(), "term").limit(most).toPandas()
    entries = entries_of(rows, (0, 1), least, ratio, surprise)
    shape = "term string, " + ", ".join(f"{c} double" for c in COUNTS)
    pairs = texts.mapInPandas(lambda frames: _phrases(frames, entries), shape).groupBy("term").agg(*[F.sum(c).alias(c) for c in COUNTS])
    total = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    usual = pairs.where((F.col("term") != "") & (clean >= spared) & (clean * n1 > toxic * n0)).orderBy(clean.desc(), "term").limit(most)
    model = Model(entries, frozenset(r["term"] for r in usual.select("term").collect()))
    if not (n0 and n1):
        share = (n1 + 0.5) / (n0 + n1 + 1)
        model.curve = (math.log(share / (1 - share)), 0.0, 0.0, 0.0)
        return model
    halves = [Model(entries_of(rows, (1 - h,), least, ratio, surprise), model.exceptions) for h in (0, 1)]

    def seen(frames):
        for frame in frames:
            yield pd.DataFrame([(int(y), *halves[int(h)].features(t)) for t, y, h in zip(frame["text"], frame["toxic"], frame["half"])],
                               columns=["y", "a", "b", "c", "d"])

    got = texts.mapInPandas(seen, "y int, a double, b double, c double, d double").orderBy("y", "b", "c", "d").toPandas()
    model.curve = tuple(map(float, _logistic(got[["a", "b", "c", "d"]].to_numpy(), got["y"].to_numpy())))
    return model


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of docs with score (0 to 1) and the matched entries, longest text whole.

    NULL and empty texts have the score of a text without entries.  Columns named score or entries are
    replaced, all others pass through unread; repeated rows stay; an empty table gives no rows.
    """
    found = F.pandas_udf(
        lambda texts: pd.DataFrame([model.assess(t) for t in texts], columns=["score", "entries"]), "score double, entries array<string>")
    out = docs.drop("score", "entries").withColumn("_toxicity", found("text"))
    return out.select(*docs.drop("score", "entries").columns, "_toxicity.score", "_toxicity.entries")


def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit(docs, table(spark, folder, "labels").where(~held))
    out = toxicity(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
