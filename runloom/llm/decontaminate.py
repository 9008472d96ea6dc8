"""Benchmark decontamination by a prefix-filtered set join.

An item window is a set of shingles (three consecutive words, or the whole of a shorter window). A
document that contains a window holds all its shingles, so the necessary prefix is one shingle, and
the rarest over all documents is taken. Documents are scanned twice: once to count the shingles of
the benchmark, once to emit the places of prefix shingles with the words around them. A bit table of
fixed size, broadcast, passes a superset of the wanted shingles; the join by shingle, the length and
positional bounds and the comparison of the words settle what remains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from runloom.llm.common import row_key, stored, table, words_of

WINDOW, SHINGLE, BITS = 10, 3, 23
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


class _Ids(dict):
    """Hash of each word; emptied when it grows large, so that a task's memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        value = self[word] = xxh64_intdigest(word)
        return value


def shingle_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words as signed 64-bit numbers."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    out = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        out = (out ^ ids[j:j + n]) * _ODD[j]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _ids(words: list[bytes], cache: _Ids) -> np.ndarray:
    return np.fromiter((cache[w] for w in words), dtype=np.uint64, count=len(words))


def item_windows(items: DataFrame, id_column: str = "item_id", text_column: str = "text", size: int = WINDOW) -> DataFrame:
    """item_id, words of each window, the number of them, and each shingle with its place and length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Ids()
        for batch in batches:
            rows = []
            for item, text in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                words = words_of(text)
                if not words:
                    continue
                ids, width = _ids(words, cache), min(size, len(words))
                short = min(SHINGLE, width)
                hashes = shingle_hashes(ids, short)
                for start in range(len(words) - width + 1):
                    body = b" ".join(words[start:start + width]).decode("utf-8", "replace")
                    rows += [(item, body, width, short, o, int(hashes[start + o])) for o in range(width - short + 1)]
            yield pd.DataFrame(rows, columns=["item_id", "body", "width", "short", "offset", "shingle"])

    return items.select(F.col(id_column).cast("string"), text_column).mapInPandas(
        run, "item_id string, body string, width int, short int, offset int, shingle long").distinct()


def _bit_table(shingles: DataFrame) -> np.ndarray:
    """Table of 2^BITS bits (1 MB) with the low bits of the shingles set; words of it, never shingles, reach the driver."""
    slot = F.col("shingle").bitwiseAND(F.lit((1 << BITS) - 1))
    words = shingles.select((slot / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bit"))
    out = np.zeros(1 << (BITS - 6), dtype=np.int64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[row["word"]] = row["bits"]
    return out


def _passes(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = hashes & ((1 << BITS) - 1)
    return np.flatnonzero((bits[slot >> 6].view(np.uint64) >> (slot & 63).astype(np.uint64)) & np.uint64(1))


def shingle_counts(docs: DataFrame, shingles: DataFrame, shorts: list[int]) -> DataFrame:
    """Occurrences over all documents of the shingles of the benchmark (and of their bit-table neighbours)."""
    shared = docs.sparkSession.sparkContext.broadcast(_bit_table(shingles))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, bits = _Ids(), shared.value
        for batch in batches:
            found = []
            for text in batch["text"]:
                ids = _ids(words_of(text), cache)
                for short in shorts:
                    hashes = shingle_hashes(ids, short)
                    found.append(hashes[_passes(hashes, bits)])
            keys, counts = np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)
            yield pd.DataFrame({"shingle": keys, "times": counts})

    return docs.select("text").mapInPandas(run, "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))


def matches(docs: DataFrame, windows: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, n_words) of every row, and row, item_id, start, width of every occurrence of a window; row as in `row_key`."""
    windows = stored(windows, "windows")
    shorts = sorted(r[0] for r in windows.select("short").distinct().collect())  # at most the numbers 1 to 3
    counts = shingle_counts(docs, windows, shorts or [SHINGLE])
    rare = windows.join(counts, "shingle", "left").fillna(0, ["times"]).groupBy("item_id", "body", "width").agg(
        F.min(F.struct("times", "offset", "shingle")).alias("least"))
    prefix = stored(rare.select("item_id", "body", "width", F.col("least.offset").alias("offset"), F.col("least.shingle").alias("shingle")), "prefix")
    shared = docs.sparkSession.sparkContext.broadcast(_bit_table(prefix))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, bits = _Ids(), shared.value
        for batch in batches:
            rows = []
            for key, row, text in zip(batch["doc_id"], batch["row"], batch["text"], strict=True):
                words = words_of(text)
                ids = _ids(words, cache)
                rows.append((key, row, len(words), None, None, None, None))
                for short in shorts:
                    hashes = shingle_hashes(ids, short)
                    for p in _passes(hashes, bits).tolist():
                        left = max(0, p - size + 1)
                        around = b" ".join(words[left:p + size]).decode("utf-8", "replace")
                        rows.append((None, row, None, int(hashes[p]), p, left, around))
            names = ["doc_id", "row", "n_words", "shingle", "at", "left", "around"]
            out = {c: [r[k] for r in rows] for k, c in enumerate(names)}
            # A float column would lose the low bits of the shingles.
            yield pd.DataFrame({c: pd.array(out[c], dtype="Int64") if c in names[2:6] else out[c] for c in names})

    # As text: a column of integers and nulls would reach pandas as floats.
    scanned = docs.select(F.col("doc_id").cast("string"), row_key(docs).alias("row"), "text").mapInPandas(
        run, "doc_id string, row binary, n_words long, shingle long, at long, left long, around string")
    scanned = stored(scanned.withColumn("doc_id", F.col("doc_id").cast(kind)), "scanned")
    places = scanned.where("shingle IS NOT NULL").join(prefix, "shingle")
    start = F.col("at") - F.col("offset")
    words = F.split("around", " ")
    inside = (start >= F.col("left")) & (start - F.col("left") + F.col("width") <= F.size(words))
    cut = F.slice(words, F.greatest(F.lit(1), (start - F.col("left") + 1).cast("int")), F.col("width"))
    hit = places.where(inside).where(F.array_join(cut, " ") == F.col("body"))
    return scanned.where("n_words IS NOT NULL").select("doc_id", "row", "n_words"), hit.select("row", "item_id", start.alias("start"), "width").distinct()


def _judged(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """The columns of `contamination`, and row."""
    lengths, hits = matches(docs, item_windows(items, size=size), size)
    hits = stored(hits, "hits")
    spots = hits.select("row", F.explode(F.sequence("start", F.col("start") + F.col("width") - 1)).alias("spot")).distinct()
    spots = spots.groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    named = hits.select("row", "item_id").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    named = named.select("row", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"))
    out = lengths.join(spots, "row", "left").join(named, "row", "left")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(
        "doc_id", "row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", empty).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits (digest of the empty string). Items without words
    have no window. Repeated items count once by item_id; every row is judged by its own text, also
    if its doc_id is null or repeated. Empty tables give no rows, or rows without hits. Other columns
    are ignored.
    """
    return _judged(docs, items, size).drop("row")


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Rows of docs without any benchmark window; each row by its own text, also if its doc_id is null or repeated."""
    bad = _judged(docs, items, size).where("contaminated").select(F.col("row").alias("_bad_row")).distinct()
    return docs.join(bad, row_key(docs) == bad["_bad_row"], "left_anti")


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP2_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, len(w) AS n, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(n, 10) AS k, array_to_string(w[s : s + least(n, 10) - 1], ' ') AS g FROM bw),
ks AS (SELECT DISTINCT k FROM win),
ds AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k),
dg AS (SELECT doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') AS g FROM ds),
hit AS (SELECT DISTINCT doc_id, item_id, s, dg.k FROM dg JOIN win ON win.g = dg.g AND win.k = dg.k),
spot AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
         FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spot ON spot.doc_id = d.doc_id LEFT JOIN item ON item.doc_id = d.doc_id
"""
