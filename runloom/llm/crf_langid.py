"""Language of code-switched text by a linear-chain conditional random field over words.

Word features are prefixes, suffixes, character trigrams and the word itself where a lexicon of the
fitted sample has it. Emission and transition weights are learned together by gradient ascent on
sequences in which pieces of documents of several languages alternate. Forward-backward labels the
words; a document takes the language with the largest share of the word marginals.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from runloom.llm.common import row_key, stored, table
from runloom.operators.sequence import topk_per_group

SLOTS, LEXICON_TIMES = 1 << 16, 3
#: Longer runs of letters, as in scripts without blanks, are labelled in consecutive pieces of so many.
LETTERS = 60
_WORD = re.compile(rf"[^\W\d_]{{1,{LETTERS}}}")


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # SLOTS x labels
    moves: np.ndarray  # labels x labels
    lexicon: frozenset[str]


def features(word: str, lexicon: frozenset[str]) -> list[int]:
    found = {f"<{word[:k]}" for k in (1, 2, 3)} | {f"{word[-k:]}>" for k in (1, 2, 3)}
    marked = f"^{word}$"
    found.update(marked[i:i + 3] for i in range(len(marked) - 2))
    if word in lexicon:
        found.add(f"={word}")
    return sorted({xxh32_intdigest(f) % SLOTS for f in found})


def _words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def forward_backward(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Marginals of padded sequences: scores is steps x sequences x labels."""
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a = np.exp(moves)
    ahead, back = np.empty_like(e), np.empty_like(e)
    ahead[0] = e[0] / e[0].sum(axis=1, keepdims=True)
    for t in range(1, len(e)):
        x = (ahead[t - 1] @ a) * e[t]
        ahead[t] = x / x.sum(axis=1, keepdims=True)
    back[-1] = 1
    for t in range(len(e) - 2, -1, -1):
        x = (back[t + 1] * e[t + 1]) @ a.T
        back[t] = x / x.sum(axis=1, keepdims=True)
    both = ahead * back
    return both / both.sum(axis=2, keepdims=True)


def fit(texts: list[tuple[str, str]], steps: int = 60, rounds: int = 4, seed: int = 7) -> Crf:
    """CRF from (text, language) rows of the bounded sample."""
    labels = sorted({lang for _, lang in texts})
    number = {x: i for i, x in enumerate(labels)}
    docs = [(number[lang], w) for text, lang in texts if (w := _words(text))]
    times = Counter(w for _, words in docs for w in words)
    lexicon = frozenset(w for w, n in times.items() if n >= LEXICON_TIMES)
    vocabulary = {w: i for i, w in enumerate(times)}
    width = max((len(features(w, lexicon)) for w in times), default=1)
    slots = np.full((len(times) + 1, width), SLOTS, dtype=np.int64)
    for w, i in vocabulary.items():
        f = features(w, lexicon)
        slots[i, :len(f)] = f
    weights, moves = np.zeros((SLOTS + 1, len(labels))), np.zeros((len(labels), len(labels)))
    if not docs:
        return Crf(labels, weights[:SLOTS], moves, lexicon)
    draw = np.random.default_rng(seed)
    pieces = [(y, [vocabulary[w] for w in words[i:i + 20]]) for y, words in docs for i in range(0, len(words), 20)]
    grown, grown_moves = np.full_like(weights, 1e-2), np.full_like(moves, 1e-2)
    for _ in range(rounds):
        draw.shuffle(pieces)
        flat_x = np.array([x for _, p in pieces for x in p])
        flat_y = np.array([y for y, p in pieces for _ in p])
        n = max(1, len(flat_x) // steps)
        if len(flat_x) < steps:
            flat_x, flat_y = np.resize(flat_x, steps), np.resize(flat_y, steps)
        xs, ys = flat_x[:n * steps].reshape(n, steps), flat_y[:n * steps].reshape(n, steps)
        for at in range(0, n, 64):
            x, y = xs[at:at + 64].T, ys[at:at + 64].T
            scores = weights[slots[x]].sum(axis=2)
            p = forward_backward(scores, moves)
            truth = np.eye(len(labels))[y]
            gap = (truth - p).reshape(-1, len(labels))
            rows = slots[x].reshape(-1, width)
            g = np.zeros_like(weights)
            for j in range(len(labels)):
                g[:, j] = np.bincount(rows.ravel(), np.repeat(gap[:, j], width), SLOTS + 1)
            g = g / x.size - 1e-7 * weights
            grown += g * g
            weights += 0.5 * g / np.sqrt(grown + 1e-12)
            weights[SLOTS] = 0
            pair = np.einsum("tbi,tbj->ij", truth[:-1], truth[1:]) - np.einsum("tbi,tbj->ij", p[:-1], p[1:])
            g = pair / x.size - 1e-4 * moves
            grown_moves += g * g
            moves += 0.2 * g / np.sqrt(grown_moves + 1e-12)
    return Crf(labels, weights[:SLOTS], moves, lexicon)


class Tagger:
    """Word marginals under a model; emission rows of words are kept, up to a bound."""

    def __init__(self, model: Crf, most: int = 300_000):
        self.model, self.most, self.place = model, most, {}
        self.rows = np.zeros((1024, len(model.labels)))

    def _row(self, word: str) -> int:
        i = self.place.get(word)
        if i is None:
            i = self.place[word] = len(self.place)
            if i >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[i] = self.model.weights[features(word, self.model.lexicon)].sum(axis=0)
        return i

    def shares(self, texts: list[list[str]]) -> np.ndarray:
        """Mean marginals of each text; texts without words give zeros."""
        out = np.zeros((len(texts), len(self.model.labels)))
        order = sorted((i for i, w in enumerate(texts) if w), key=lambda i: len(texts[i]))
        at = 0
        while at < len(order):
            if len(self.place) > self.most:
                self.place.clear()
            upto = at + 1
            while upto < len(order) and upto - at < 256 and len(texts[order[upto]]) * (upto - at + 1) <= 300_000 and len(
                    texts[order[upto]]) <= 1.5 * len(texts[order[at]]) + 50:
                upto += 1
            group = order[at:upto]
            longest = len(texts[group[-1]])
            index = np.zeros((longest, len(group)), dtype=np.int64)
            mask = np.zeros((longest, len(group), 1))
            for k, i in enumerate(group):
                n = len(texts[i])
                index[:n, k] = [self._row(w) for w in texts[i]]
                mask[:n, k] = 1
            # A step of padding has equal scores and comes after the words: it adds no evidence to them
            # beyond the row sums of the transitions, so its backward message is reset to one below.
            p = _masked(self.rows[index] * mask, self.model.moves, mask)
            out[group] = (p * mask).sum(axis=0) / mask.sum(axis=0)
            at = upto
        return out


def _masked(scores: np.ndarray, moves: np.ndarray, mask: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a = np.exp(moves)
    ahead, back = np.empty_like(e), np.ones_like(e)
    ahead[0] = e[0] / e[0].sum(axis=1, keepdims=True)
    for t in range(1, len(e)):
        x = (ahead[t - 1] @ a) * e[t]
        ahead[t] = x / x.sum(axis=1, keepdims=True)
    for t in range(len(e) - 2, -1, -1):
        x = (back[t + 1] * e[t + 1]) @ a.T
        back[t] = np.where(mask[t + 1] > 0, x / x.sum(axis=1, keepdims=True), 1.0)
    both = ahead * back
    return both / both.sum(axis=2, keepdims=True)


def labelled_sample(docs: DataFrame, sample: int = 1000) -> list[tuple[str, str]]:
    """(text, lang) of at most `sample` rows (one a language at least), about equally many of each language.

    Copies count once: the texts are those with the least hash among the distinct texts of their
    language, so the sample depends neither on copies nor on how the table is partitioned.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang", F.xxhash64("text").alias("_h"))
    hashes = stored(rows.select("lang", "_h").distinct(), "labelled")
    langs = hashes.select("lang").distinct().count()
    if not langs:
        return []
    each = max(1, sample // langs)
    picked = topk_per_group(hashes, ["lang"], [F.asc("_h")], each).select("lang", "_h").collect()
    few = docs.sparkSession.createDataFrame(picked, hashes.schema)
    texts = rows.join(F.broadcast(few), ["lang", "_h"]).groupBy("lang", "_h").agg(F.min("text").alias("text"))
    return [(r["text"], r["lang"]) for r in texts.orderBy("lang", "_h").collect()]


def train(docs: DataFrame, sample: int = 1000) -> Crf:
    """Model from the `labelled_sample` of docs (text, lang), whose bound keeps the fit on the driver small."""
    picked = labelled_sample(docs, sample)
    return fit(picked) if picked else Crf([], np.zeros((SLOTS, 0)), np.zeros((0, 0)), frozenset())


def predict(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs, from its text alone.

    Null texts and texts without a letter, and all texts where nothing was learned, are `und` with
    score 0. Long texts are labelled whole. Repeated rows are each predicted; an empty table gives no
    rows; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf = shared.value
        tagger = Tagger(crf)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at:at + 1000]
                texts = [_words(t) for t in part["text"]]
                shares = tagger.shares(texts) if crf.labels else np.zeros((len(texts), 1))
                best = shares.argmax(axis=1)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(),
                    "lang_pred": [crf.labels[b] if w and crf.labels else "und" for w, b in zip(texts, best, strict=True)],
                    "score": np.clip(shares.max(axis=1), 0, 1)})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")


def learning(docs: DataFrame) -> DataFrame:
    return docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of docs with an identified language: all but those predicted `und`, however mixed their words are.

    Each row is judged by its own text, also if its doc_id is null or repeated. Where nothing was
    learned no row is identified; an empty table gives no rows; other columns pass through.
    """
    good = predict(docs.select(row_key(docs).alias("doc_id"), "text"), train(learning(docs))).where("lang_pred != 'und'")
    good = good.select(F.col("doc_id").alias("_good_row")).distinct()
    return docs.join(good, row_key(docs) == good["_good_row"], "left_semi")


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out")
    return predict(docs, train(learning(docs))).select("doc_id", held, "lang_pred", "score")
