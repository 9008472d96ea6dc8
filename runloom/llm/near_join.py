"""Near-duplicate join: MinHash banding for candidates, exact Jaccard for links.

Texts with the same set of shingles form one class member (a rep) first. Each rep has a key per
tree (band): the hash of a signature prefix, whose depth is the greatest at which pairs at the
threshold meet in some tree with the expected target recall (4 with the constants). Reps that share a key are joined to components; inside a component all sets are compared in blocks of
bounded size, so a large group is many tasks and never a list of pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.common import row_key, stored, table, words_of
from runloom.llm.decontaminate import _Ids, _ids

TREES, DEPTH, RECALL, THRESHOLD, SHINGLE = 16, 8, 0.9995, 0.8, 5
#: Bounds of one block: reps, and shingles of all its reps.
BLOCK_ROWS, BLOCK_SHINGLES = 1000, 1_000_000
#: Bits of the largest table of candidates that is broadcast (16 MB); beyond, it lets more texts through to the join, which decides.
MOST_BITS = 27


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Longest prefix at which pairs at the threshold share one in some tree with the recall."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_set(words: list[bytes], cache: _Ids, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingles; a shorter text is one shingle, a text without words none."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    ids = _ids(words, cache)
    size = min(size, len(ids))
    n = len(ids) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        out = (out ^ ids[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return np.unique(out)


def signature(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        mixed = shingles[at:at + 4096, None] * factors + offsets
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0), out=least)
    return least


def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    return draw.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, count, dtype=np.uint64)


def sketches(docs: DataFrame, depth: int, trees: int = TREES) -> DataFrame:
    """doc_id, digest of the shingle set, its size and the prefix key of each tree."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    factors, offsets = _coefficients(trees * depth)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Ids()
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                shingles = shingle_set(words_of(text), cache)
                if not len(shingles):
                    rows.append((key, None, 0, []))
                    continue
                parts = signature(shingles, factors, offsets).reshape(trees, depth)
                keys = parts[:, 0].copy()
                for j in range(1, depth):
                    keys = (keys * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (keys >> np.uint64(29)) ^ parts[:, j]
                rows.append((key, hashlib.sha256(shingles.tobytes()).hexdigest(), len(shingles), keys.view(np.int64).tolist()))
            yield pd.DataFrame(rows, columns=["doc_id", "digest", "size", "prefixes"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, digest string, size int, prefixes array<long>")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Node and root (least node) of each connected component of edges (a, b), by alternating stars."""
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        large = stored(large, name)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a != b").distinct(), name)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def block_links(block: pd.DataFrame, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Weighted link counts of each row and a spanning forest of the links, between the two sides (or within one)."""
    sets = [np.asarray(s, dtype=np.int64) for s in block["shingles"]]
    sizes = np.array([len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    common, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    one_sided = block["bi"].iloc[0] == block["bj"].iloc[0]
    side = np.ones(len(sets), dtype=bool) if one_sided else (block["own"] == block["bi"]).to_numpy()
    left, right = np.flatnonzero(side), np.flatnonzero(side if one_sided else ~side)
    place = np.zeros(len(sets), dtype=np.int64)
    place[right] = np.arange(len(right))
    if not one_sided:
        place[left] = np.arange(len(left))
    inter = np.zeros((len(left), len(right)), dtype=np.float32)
    step = 4096
    for at in range(0, len(common), step):
        lo, hi = np.searchsorted(column, (at, at + step))
        r, c = row[lo:hi], column[lo:hi] - at
        x = np.zeros((len(left), step), dtype=np.float32)
        y = x if one_sided else np.zeros((len(right), step), dtype=np.float32)
        on = side[r]
        x[place[r[on]], c[on]] = 1
        if not one_sided:
            y[place[r[~on]], c[~on]] = 1
        inter += x @ y.T
    linked = inter >= threshold * (sizes[left][:, None] + sizes[right][None, :] - inter) - 1e-6
    if one_sided:
        np.fill_diagonal(linked, False)
    weight = block["copies"].to_numpy()
    counts = np.zeros(len(sets), dtype=np.int64)
    counts[left] += linked @ weight[right]
    if not one_sided:
        counts[right] += linked.T @ weight[left]
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest = []
    for i in range(len(left)):
        for j in right[np.flatnonzero(linked[i])].tolist():
            p, q = root(int(left[i])), root(j)
            if p != q:
                parent[max(p, q)] = min(p, q)
                forest.append((int(left[i]), j))
    return counts, forest


def candidate_bits(reps: DataFrame) -> np.ndarray:
    """Table with a bit set for the hash of each rep, 16 bits a rep up to the bound; words of it reach the driver, never reps."""
    bits = min(MOST_BITS, max(16, (16 * reps.count()).bit_length()))
    slot = F.xxhash64("rep").bitwiseAND(F.lit((1 << bits) - 1))
    words = reps.select((slot / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bit"))
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[row["word"]] = row["bits"]
    return out


def candidate_texts(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """rep and text of the rows of docs that may be reps: only these are shuffled to the join."""
    shared = docs.sparkSession.sparkContext.broadcast(candidate_bits(reps).view(np.uint64))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table_ = shared.value
        for batch in batches:
            slot = batch["hash"].to_numpy() & (64 * len(table_) - 1)
            yield batch[((table_[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)) > 0][["rep", "text"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").alias("rep"), F.xxhash64("doc_id").alias("hash"), "text")
    return rows.mapInPandas(keep, f"rep {kind}, text string")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), n_links, copies.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles reaches
    the threshold; n_links counts linked documents, copies included. copies counts documents with the
    same set. Null, empty and wordless texts have no links and are classes of their own; texts under
    five words are one shingle. Every row is judged by its own text, also if its doc_id is null or
    repeated; class_id is null where no row of a class has a doc_id. Empty tables give no rows; other
    columns are ignored.
    """
    return _classes(docs, threshold, trees, recall).select("doc_id", "class_id", "n_links", "copies")


def _classes(docs: DataFrame, threshold: float, trees: int, recall: float) -> DataFrame:
    """The columns of `near_duplicates`, row as in `row_key`, and stays: is this the row of its class that is kept?"""
    found = stored(_keyed_classes(docs.select(row_key(docs).alias("doc_id"), "text"), threshold, trees, recall), "keyed")
    found = found.select(F.col("doc_id").alias("row"), F.col("class_id").alias("class_row"), "n_links", "copies", "wordless").distinct()
    rows = docs.select("doc_id", row_key(docs).alias("row")).join(found, "row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    named = rows.groupBy("class_row").agg(first).select("class_row", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("first_row"))
    return rows.join(named, "class_row").select("doc_id", "class_id", "n_links", "copies", "row", (F.col("wordless") | (F.col("row") == F.col("first_row"))).alias("stays"))


def _keyed_classes(docs: DataFrame, threshold: float, trees: int, recall: float) -> DataFrame:
    """Classes of rows whose doc_id is never null and whose text follows from it."""
    depth = prefix_depth(threshold, trees, DEPTH, recall)
    all_rows = stored(sketches(docs, depth, trees), "sketches")
    reps = all_rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("size").alias("size"))
    reps = stored(reps, "reps")
    tries = all_rows.join(reps.select("digest", "rep"), "digest").where("doc_id = rep").select("rep", F.posexplode("prefixes").alias("tree", "prefix")).distinct()
    least = tries.groupBy("tree", "prefix").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = tries.join(least, ["tree", "prefix"]).select(F.col("rep").alias("a"), "b")
    groups = stored(components(edges, "tries"), "groups")
    weights = groups.join(reps, groups["node"] == reps["rep"]).select("rep", "root", "copies", "size")
    blocks = weights.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = stored(weights.join(blocks, "root"), "members")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Ids()
        for batch in batches:
            batch["shingles"] = [shingle_set(words_of(t), cache).view(np.int64) for t in batch["text"]]
            yield batch.drop(columns="text")

    texts = candidate_texts(docs, members.select("rep")).join(members, "rep")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["rep"])
    held = texts.select("rep", "root", "copies", "blocks", "text").mapInPandas(sets, f"rep {kind}, root {kind}, copies long, blocks int, shingles array<long>")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("rep", "root", "copies", "shingles", "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))

    def link(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rep", ignore_index=True)
        counts, forest = block_links(block, threshold)
        names = block["rep"].tolist()
        rows = [(names[i], None, int(c)) for i, c in enumerate(counts) if c] + [(names[i], names[j], 0) for i, j in forest]
        return pd.DataFrame(rows, columns=["a", "b", "links"])

    links = stored(dealt.groupBy("root", "bi", "bj").applyInPandas(link, f"a {kind}, b {kind}, links long"), "links")
    classes = components(links.where("b IS NOT NULL").select("a", "b"), "links")
    counted = links.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    known = reps.join(classes, reps["rep"] == classes["node"], "left").join(counted, reps["rep"] == counted["a"], "left")
    known = known.select("digest", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    out = all_rows.select("doc_id", "digest").join(known, "digest", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), F.col("digest").isNull().alias("wordless"))


def one_per_class(docs: DataFrame) -> DataFrame:
    """Of each class the row with the least doc_id (nulls last); texts without words all stay.

    Of rows that repeat both doc_id and text in one class one stays, whichever.
    """
    found = stored(_classes(docs, THRESHOLD, TREES, RECALL), "classes")
    drop = found.where("NOT stays").select(F.col("row").alias("_lost_row")).distinct()
    kept = docs.join(drop, row_key(docs) == drop["_lost_row"], "left_anti")
    again = found.where("stays AND class_id IS NOT DISTINCT FROM doc_id AND copies > 1").groupBy("row").count().where("count > 1")
    again = again.select(F.col("row").alias("_lost_row"))
    if again.isEmpty():
        return kept
    single = kept.join(again, row_key(kept) == again["_lost_row"], "left_semi").withColumn("_lost_row", row_key(kept)).dropDuplicates(["_lost_row"])
    return kept.join(again, row_key(kept) == again["_lost_row"], "left_anti").unionByName(single.drop("_lost_row"))


def op10_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
