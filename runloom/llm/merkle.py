"""Merkle manifest of a dataset: one binary tree per language, one over the languages, and a proof per row.

A tree is cut into superblocks of 2^bits consecutive nodes.  On the way up each superblock is reduced to
the one node that stands `bits` levels above it, and these outer nodes form a tree that is cut again, so
a few rounds reach the subroot whatever the size of the tree.  On the way down the nodes of a superblock
are cogrouped with the outer path of that one node: the group then holds all it needs to repeat the
local reduction, to join each node's siblings to the outer path and to fold a leaf up to the root.
Trees smaller than a superblock share one, so many small languages do not mean many small groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.common import ranked, stored, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK = ("_big", "_block", "_part")


def leaf_of(fields: Sequence[Column]) -> Column:
    """Hex SHA-256 over each field as byte length, colon and value, or `-` if null."""
    parts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p), F.lit(":"), p), F.lit("-")) for p in parts]), 256)


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def lifts(n: int, bits: int) -> int:
    """Levels a superblock of a tree of n nodes is raised: up to its root, or `bits` if the tree has more blocks."""
    return min(bits, (n - 1).bit_length())


def raised(nodes: list[str], times: int) -> list[list[str]]:
    """The levels of a block, nodes first; a lone node at the end of a level is hashed by itself."""
    levels = [nodes]
    for _ in range(times):
        low = levels[-1]
        levels.append([h(*low[i:i + 2]) for i in range(0, len(low), 2)])
    return levels


def siblings(levels: list[list[str]], at: int) -> list[str]:
    """Per level the other node of the run, after L or R for its side; `-` where the run has one node."""
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append(("L" if other < at else "R") + level[other] if other < len(level) else "-")
        at >>= 1
    return out


def step(node: str, sibling: str) -> str:
    if sibling == "-":
        return h(node)
    return h(sibling[1:], node) if sibling[0] == "L" else h(node, sibling[1:])


def in_blocks(nodes: DataFrame, bits: int) -> DataFrame:
    big = F.col("_n") > (1 << bits)
    return nodes.withColumns({
        "_big": big, "_block": F.when(big, F.col("_first")).otherwise(F.shiftright("_first", bits)),
        "_part": F.when(big, F.shiftright("_pos", bits)).otherwise(F.lit(0).cast("long"))})


def _trees(block: pd.DataFrame):
    """The trees, or the part of one tree, that a superblock holds."""
    for first, rows in block.sort_values(["_first", "_pos"]).groupby("_first", sort=False):
        yield int(first), int(rows["_n"].iloc[0]), rows


def reduced(nodes: DataFrame, bits: int) -> DataFrame:
    """One node per superblock and tree, with the size of the outer tree and its place in it."""
    def up(block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for first, n, rows in _trees(block):
            top = raised(rows["_hash"].tolist(), lifts(n, bits))[-1][0]
            out.append((first, -(-n >> bits), int(rows["_pos"].iloc[0]) >> bits, top))
        key = tuple(block[c].iloc[0] for c in BLOCK)
        return pd.DataFrame([(*o, *key) for o in out], columns=["_first", "_n", "_pos", "_hash", "_was_big", "_was_block", "_was_part"])

    shape = "_first long, _n long, _pos long, _hash string, _was_big boolean, _was_block long, _was_part long"
    return in_blocks(nodes.select("_first", "_n", "_pos", "_hash"), bits).groupBy(*BLOCK).applyInPandas(up, shape)


def tower(leaves: DataFrame, bits: int) -> list[DataFrame]:
    """Stored levels of superblock nodes above the leaves; the last one has one node per tree."""
    levels, size = [], leaves.agg(F.max("_n")).first()[0] or 0
    while not levels or size > 1:
        levels.append(stored(reduced(levels[-1] if levels else leaves, bits), "merkle"))
        size = -(-size >> bits)
    return levels


def descend(nodes: DataFrame, above: DataFrame, bits: int, extra: str, finish) -> DataFrame:
    """Cogroup each superblock of `nodes` with the outer paths of its nodes in `above`.

    `finish(row, path, outer)` makes the values of the columns `extra` from a node, its siblings up to the
    tree's root and beyond, and the row of `above`.
    """
    names = [c.split()[0] for c in extra.split(", ")]

    def join(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        over = {o["_first"]: o for o in outer.to_dict("records")}
        out = []
        for first, n, rows in _trees(block):
            above_it = over[first]
            rest = above_it["_path"].split()
            levels = raised(rows["_hash"].tolist(), lifts(n, bits))
            folded: dict[str, str] = {}
            for at, row in enumerate(rows.to_dict("records")):
                out.append(finish(row, siblings(levels, at), rest, above_it, folded))
        return pd.DataFrame(out, columns=names)

    left = in_blocks(nodes, bits).groupBy(*BLOCK)
    return left.cogroup(above.groupBy("_was_big", "_was_block", "_was_part")).applyInPandas(join, extra)


def _pass_on(row, near, rest, above, folded):
    return (row["_first"], row["_pos"], row["_was_big"], row["_was_block"], row["_was_part"], " ".join(near + rest),
            above["_sub"], above["_root"])


PASSED = "_first long, _pos long, _was_big boolean, _was_block long, _was_part long, _path string, _sub string, _root string"


def paths_down(levels: list[DataFrame], top: DataFrame, bits: int) -> DataFrame:
    """Outer paths of the lowest stored level, from the paths of the trees' roots in `top`."""
    above = top
    for below in reversed(levels[:-1]):
        above = stored(descend(below, above, bits, PASSED, _pass_on), "merkle-paths")
    return above


def _prove(row, near, rest, above, folded):
    """Proof digest, and the root folded from the checked leaf; equal nodes above a block are folded once."""
    node = row["_checked"]
    for s in near:
        node = step(node, s)
    if node not in folded:
        root = node
        for s in rest:
            root = step(root, s)
        folded[node] = root
    path = near + rest
    return (row["_row"], row["_hash"], above["_sub"], above["_root"], " ".join(path), h(*[s[1:] for s in path if s != "-"]), folded[node])


def manifest(docs: DataFrame, checked: Column | None = None, bits: int = 12, with_paths: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and, if asked, the proof path of each row.

    `checked` is the n_chars to verify against the manifest, by default the row's own: a changed value
    gives another leaf, which is folded with the siblings of the manifest.  Missing values are part of the
    leaf (`-`); a null language is a tree of its own, before all others.  Rows of a tree stand by doc_id,
    nulls first, rows of one doc_id by leaf; rows repeated in full have equal leaves at several places.
    Empty and long texts are hashed whole.  Other columns are not read.  An empty table gives no rows.
    The path lists, from the leaf to the root, L or R and the sibling, or `-` where there is none.
    """
    own = leaf_of([F.col(c) for c in FIELDS])
    rows = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), own.alias("_hash"), *([] if checked is None else [
        F.when(checked.eqNullSafe(F.col("n_chars")), None).otherwise(
            leaf_of([checked if c == "n_chars" else F.col(c) for c in FIELDS])).alias("_other")]))
    if checked is None:
        rows = rows.withColumn("_other", F.lit(None).cast("string"))
    leaves = ranked(rows, ["lang"], [F.col("doc_id"), F.col("_hash")], "merkle-leaves")
    levels = tower(leaves, bits)
    langs = leaves.where("_pos = 0").select("lang", F.col("_first").alias("_tree"))
    subroots = langs.join(levels[-1].withColumnRenamed("_first", "_tree"), "_tree").drop("_n", "_pos")
    # The tree over the languages is a tree like the others: its key is the same for all its nodes.
    outer = ranked(subroots.withColumn("_all", F.lit(0)), ["_all"], [F.col("lang")], "merkle-subroots")
    crown = tower(outer.select("_first", "_n", "_pos", "_hash"), bits)
    root = crown[-1].select("_first", F.lit("").alias("_path"), F.col("_hash").alias("_root"), F.lit("").alias("_sub"),
                            "_was_big", "_was_block", "_was_part")
    top = descend(
        outer, paths_down(crown, root, bits), bits,
        "_first long, _was_big boolean, _was_block long, _was_part long, _path string, _sub string, _root string",
        lambda row, near, rest, above, folded: (row["_tree"], row["_was_big"], row["_was_block"], row["_was_part"],
                                                " ".join(near + rest), row["_hash"], above["_root"]))
    above = paths_down(levels, stored(top, "merkle-tops"), bits)
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    nodes = leaves.select("_first", "_n", "_pos", "_hash", F.coalesce("_other", "_hash").alias("_checked"), F.col("doc_id").cast("string").alias("_row"))
    proved = descend(
        nodes, above, bits, "doc_id string, leaf string, subroot string, root string, path string, proof_sha256 string, folded_root string", _prove)
    out = proved.select(F.col("doc_id").cast(kind).alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"), "path")
    return out if with_paths else out.drop("path")


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return manifest(docs, F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars")))


# CRC-32 of the decimal doc_id, bit by bit: 3988292384 is the reversed polynomial.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _sql_leaf(n_chars: str) -> str:
    parts = ["doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen({p})::VARCHAR || ':' || {p}, '-')" for p in parts) + ")"


OP12_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_sql_leaf('n_chars')} AS leaf,
         CASE WHEN {_CRC} % 7 = 0 THEN {_sql_leaf('n_chars + 1')} ELSE {_sql_leaf('n_chars')} END AS shown
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
tree AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY place) AS nodes FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
  FROM tree WHERE len(nodes) > 1),
subs AS (
  SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS rank, level AS height
  FROM tree WHERE len(nodes) = 1),
crown AS (
  SELECT 0 AS level, list(subroot ORDER BY rank) AS nodes FROM subs
  UNION ALL
  SELECT level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
  FROM crown WHERE len(nodes) > 1),
sides AS (
  SELECT p.lang, p.doc_id, p.leaf, p.shown, p.place, t.level, p.place >> t.level AS k, t.nodes
  FROM placed p JOIN tree t ON t.lang IS NOT DISTINCT FROM p.lang AND len(t.nodes) > 1
  UNION ALL
  SELECT p.lang, p.doc_id, p.leaf, p.shown, p.place, s.height + c.level, s.rank >> c.level, c.nodes
  FROM placed p JOIN subs s ON s.lang IS NOT DISTINCT FROM p.lang JOIN crown c ON len(c.nodes) > 1),
paths AS (
  SELECT lang, place, list(CASE WHEN k % 2 = 1 THEN {{'l': nodes[k], 'r': ''}} ELSE {{'l': '', 'r': coalesce(nodes[k + 2], '')}} END ORDER BY level) AS path
  FROM sides GROUP BY lang, place),
folded AS (
  SELECT p.doc_id, p.lang, p.place, p.leaf, p.shown AS node, coalesce(q.path, []) AS path, 0 AS done
  FROM placed p LEFT JOIN paths q ON q.lang IS NOT DISTINCT FROM p.lang AND q.place = p.place
  UNION ALL
  SELECT doc_id, lang, place, leaf, sha256(path[done + 1].l || node || path[done + 1].r), path, done + 1 FROM folded WHERE done < len(path))
SELECT f.doc_id, f.leaf, s.subroot, r.nodes[1] AS root,
       sha256(list_aggregate(list_concat([''], list_transform(f.path, lambda p: p.l || p.r)), 'string_agg', '')) AS proof_sha256,
       f.node AS folded_root, f.node = r.nodes[1] AS verified
FROM folded f JOIN subs s ON s.lang IS NOT DISTINCT FROM f.lang, (SELECT nodes FROM crown WHERE len(nodes) = 1) r
WHERE f.done = len(f.path)
"""
