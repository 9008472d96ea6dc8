"""Repair of conversation structure: the cheapest edits that make the roles `(s?(ua)+)?`.

What is left to pay after a row depends on the row's symbol (one of nine) and on how far the grammar has
come (four states), so it is a vector of four costs.  Vectors that differ by a constant lead to the same
decisions, and only a few dozen normalised ones can occur.  Tables built once hold, for each of them and
each block of BLOCK symbols, the vector before the block and the state behind it for each state before it
(the method of the Four Russians): a conversation is walked from its end one block at a time by lookup.
The edits are then traced from its start: each block is expanded backward from the vector behind it, which
gives the cost to finish at every row, and the ASCII-least letter that still reaches it is taken.

A long conversation is cut into chunks.  Each chunk is first reduced to its effect on every vector and
state, the effects are chained per conversation, and then all chunks are traced side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions.quantiles import null_safe_join
from runloom.llm.common import ranked, stored, table

BLOCK = 4
CHUNK = 8192
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a.  Row classes: s, u, a, other.
NEXT = (2, 2, 3, 2)
KEEP = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
SYMBOLS = 9
MUST_DELETE = 8
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
SPACE = " \t\n\x0b\x0c\r"
ROLE_OF = {2: "u", 3: "a"}
ENDS = (0, 10, 5, 0)


def _letters(symbol: int, state: int):
    """Letters that consume a row, with their costs and the states behind them, in ASCII order."""
    yield "D", DELETE, state
    if symbol != MUST_DELETE:
        kind, cut = divmod(symbol, 2)
        if kind in KEEP[state]:
            yield "K", cut * TRUNCATED, KEEP[state][kind]
        yield "R", cut * TRUNCATED + REROLE, NEXT[state]


def _before(symbol: int, after: tuple[int, ...]) -> list[int]:
    """Least cost to finish from each state before a row, given the costs behind it."""
    costs = [min(c + after[q] for _, c, q in _letters(symbol, s)) for s in range(4)]
    for _ in range(2):  # two inserts lead back to the same state
        costs = [min(costs[s], INSERT + costs[NEXT[s]]) for s in range(4)]
    return costs


class _Tables:
    """Transitions of normalised vectors over one symbol and over a block."""

    def __init__(self):
        ids, todo, vectors = {ENDS: 0}, [ENDS], [ENDS]
        before, exits = [], []
        while todo:
            after = todo.pop(0)
            row, out = [], []
            for symbol in range(SYMBOLS):
                costs = _before(symbol, after)
                low = min(costs)
                new = tuple(c - low for c in costs)
                if new not in ids:
                    ids[new] = len(vectors)
                    vectors.append(new)
                    todo.append(new)
                row.append(ids[new])
                out.append([self._trace(symbol, s, costs, after)[1] for s in range(4)])
            before.append(row)
            exits.append(out)
        self.vectors, self.before1 = vectors, np.array(before, np.int16)
        self.exit1 = np.array(exits, np.int8)
        self.before, self.exit = self.before1, self.exit1
        for _ in range(BLOCK - 1):
            self._prepend()

    def _prepend(self):
        """One more symbol in front of the block; its code is the most significant digit."""
        v, width = self.before.shape
        mid = self.before  # vector between the new symbol and the old block
        before = self.before1[mid]  # vector, code, new symbol
        first = self.exit1[mid]  # vector, code, new symbol, state
        rest = np.broadcast_to(self.exit[:, :, None, :], first.shape)
        exits = np.take_along_axis(rest, first.astype(np.int64), axis=3)
        self.before = before.transpose(0, 2, 1).reshape(v, width * SYMBOLS)
        self.exit = exits.transpose(0, 2, 1, 3).reshape(v, width * SYMBOLS, 4).astype(np.int8)

    @staticmethod
    def _trace(symbol: int, state: int, costs: list[int], after: tuple[int, ...]) -> tuple[str, int]:
        """ASCII-least cheapest letters up to and with the row's own, each with its role, and the state behind them.

        D comes before I, I before K and R; a row's letters are D, K or R.
        """
        edits = ""
        while True:
            ways = {letter: q for letter, c, q in _letters(symbol, state) if c + after[q] == costs[state]}
            if "D" not in ways and INSERT + costs[NEXT[state]] == costs[state]:
                state = NEXT[state]
                edits += "I" + ROLE_OF[state]
                continue
            letter = min(ways)
            state = ways[letter]
            return edits + letter + (ROLE_OF[state] if letter == "R" else "-"), state

    def step(self, vector: int, symbol: int, state: int) -> tuple[str, int]:
        after = self.vectors[vector]
        return self._trace(symbol, state, _before(symbol, after), after)


@lru_cache(maxsize=1)
def tables() -> _Tables:
    return _Tables()


@lru_cache(maxsize=1 << 16)
def _expand(vector: int, block: bytes, state: int) -> tuple[tuple[str, ...], int]:
    """Edits of a block's rows from the vector behind it: expanded backward, traced forward."""
    t = tables()
    behind = [vector]
    for symbol in reversed(block[1:]):
        behind.append(int(t.before1[behind[-1], symbol]))
    out = []
    for symbol, v in zip(block, reversed(behind)):
        edits, state = t.step(v, symbol, state)
        out.append(edits)
    return tuple(out), state


def _cut(symbols: bytes) -> list[bytes]:
    return [symbols[i:i + BLOCK] for i in range(0, len(symbols), BLOCK)]


def _code(block: bytes) -> int:
    code = 0
    for symbol in block:
        code = code * SYMBOLS + symbol
    return code


def trace(symbols: bytes, vector: int = 0, state: int = 0) -> tuple[list[str], int]:
    """Edits of each row and the last state, given the vector behind the rows and the state before them."""
    t = tables()
    blocks = _cut(symbols)
    behind = [vector]
    for block in reversed(blocks[1:]):
        v = behind[-1]
        if len(block) == BLOCK:
            behind.append(int(t.before[v, _code(block)]))
        else:
            for symbol in reversed(block):
                v = int(t.before1[v, symbol])
            behind.append(v)
    out: list[str] = []
    for block, v in zip(blocks, reversed(behind)):
        edits, state = _expand(v, block, state)
        out += edits
    return out, state


def effect(symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The vector before the rows for each vector behind them, and the state behind them for each state before them."""
    t = tables()
    v = np.arange(len(t.vectors))
    exits = np.tile(np.arange(4, dtype=np.int8), (len(v), 1))
    for block in reversed(_cut(symbols)):
        if len(block) == BLOCK:
            code = _code(block)
            exits = np.take_along_axis(exits, t.exit[v, code].astype(np.int64), axis=1)
            v = t.before[v, code].astype(np.int64)
        else:
            for symbol in reversed(block):
                exits = np.take_along_axis(exits, t.exit1[v, symbol].astype(np.int64), axis=1)
                v = t.before1[v, symbol].astype(np.int64)
    return v, exits


def closing(state: int) -> str:
    """Edits after the last row that bring the grammar to an end."""
    out = ""
    while state in (1, 2):
        state = NEXT[state]
        out += "I" + ROLE_OF[state]
    return out


# --- rows in order ----------------------------------------------------------------------------
def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the planned faults; NULL texts and roles are one space."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fault = F.crc32(name) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    text = F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text)
    out = rows.where(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"), text.alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_twice"))
    return out.drop("_twice")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows with their place in the conversation, by turn (NULLs first), role, first 64 characters and hash of the text.

    `fault` is blank, duplicate, truncated or NULL.  Repeated texts are found by the least place of each
    (conversation, role, text), which is combined before the shuffle.
    """
    space = F.lit(" ")
    clean = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    # Texts of one role and turn stand by their first characters and hash: short keys bound the range samples.
    order = [F.col("turn"), F.col("role"), F.substring("text", 1, 64), F.xxhash64("text")]
    placed = ranked(clean, ["conv_id"], order, "conversations")
    firsts = placed.groupBy("conv_id", "role", "text").agg(F.min("_id").alias("_id")).select("_id", F.lit(False).alias("_again"))
    ends = placed.select("_id", F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1)).alias("_end"), F.substring("role", 1, 1).alias("_initial"))
    fault = F.when(F.col("_end") == "", "blank").when(F.col("_again").isNull(), "duplicate").when(~F.col("_end").isin(".", "!", "?"), "truncated")
    kind = F.when(F.col("_initial") == "s", 0).when(F.col("_initial") == "u", 1).when(F.col("_initial") == "a", 2).otherwise(3)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), MUST_DELETE).otherwise(
        2 * kind + F.when(F.col("fault") == "truncated", 1).otherwise(0))
    flags = ends.join(firsts, "_id", "left").withColumn("fault", fault).select("_id", "fault", symbol.cast("int").alias("_symbol"))
    return placed.join(stored(flags, "conversation-flags"), "_id")


# --- edits ------------------------------------------------------------------------------------
def _chunks(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[dict, list[int], bytearray]]:
    """Chunks of rows that stand together: values of the first row, row ids and symbols."""
    key, ids, symbols, head = None, [], bytearray(), {}
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        for i, now in enumerate(zip(*[columns[k] for k in keys])):
            if now != key:
                if ids:
                    yield head, ids, symbols
                key, ids, symbols = now, [], bytearray()
                head = {n: c[i] for n, c in columns.items()}
            ids.append(columns["_id"][i])
            symbols.append(columns["_symbol"][i])
    if ids:
        yield head, ids, symbols


KEYS = ("_first", "_chunk")


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for head, _, symbols in _chunks(batches, KEYS):
        before, exits = effect(bytes(symbols))
        yield pa.RecordBatch.from_pydict({
            "_first": pa.array([head["_first"]], pa.int64()), "_chunk": pa.array([head["_chunk"]], pa.int64()),
            "before": pa.array([before.astype(np.int16).tobytes()], pa.binary()), "exits": pa.array([exits.tobytes()], pa.binary())})


def _chain(effects):
    """Per conversation: the vector behind each chunk, from the last one, and the state before it, from the first one."""
    effects = effects.sort_values("_chunk")
    vectors, v = [], 0
    for raw in reversed(effects["before"].tolist()):
        vectors.append(v)
        v = int(np.frombuffer(raw, np.int16)[v])
    vectors.reverse()
    states, q = [], 0
    for raw, v in zip(effects["exits"], vectors):
        states.append(q)
        q = int(np.frombuffer(raw, np.int8).reshape(-1, 4)[v, q])
    return effects[["_first", "_chunk"]].assign(_vector=vectors, _state=states)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for head, ids, symbols in _chunks(batches, KEYS):
        edits, state = trace(bytes(symbols), head["_vector"], head["_state"])
        if head["_last"]:
            edits[-1] += closing(state)
        yield pa.RecordBatch.from_pydict({"_id": pa.array(ids, pa.int64()), "edits": pa.array(edits, pa.string())})


def edits_of(placed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """_id and the edits at each row: pairs of a letter and the new role's initial, `-` for none."""
    # Rows of a chunk after the first are in order; whether a chunk is the last one follows from its number.
    narrow = placed.select("_first", "_id", "_symbol", "_n", F.floor(F.col("_pos") / chunk).alias("_chunk"))
    many = narrow.where(F.col("_n") > chunk).repartition("_first", "_chunk").sortWithinPartitions("_first", "_chunk", "_id")
    effects = many.mapInArrow(_effects, "_first long, _chunk long, before binary, exits binary")
    links = effects.groupBy("_first").applyInPandas(_chain, "_first long, _chunk long, _vector int, _state int")
    linked = narrow.join(links, ["_first", "_chunk"], "left").select(
        "_first", "_chunk", "_id", "_symbol", F.coalesce("_vector", F.lit(0)).alias("_vector"), F.coalesce("_state", F.lit(0)).alias("_state"),
        (F.col("_chunk") == F.floor((F.col("_n") - 1) / chunk)).alias("_last"))
    return linked.repartition("_first", "_chunk").sortWithinPartitions("_first", "_chunk", "_id").mapInArrow(_edits, "_id long, edits string")


def repaired(placed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per edit: conv_id, _first, _id, step, turn, edit (K, R, D, I), role, text and cost.

    Deleted rows are there with their own role and text; inserted rows have an empty text and no turn.
    """
    rows = placed.select("_id", "_first", "conv_id", "turn", "role", "text", "fault").join(edits_of(placed, chunk), "_id")
    rows = rows.select("*", F.posexplode(F.regexp_extract_all("edits", F.lit("(..)"), F.lit(1))).alias("step", "_pair"))
    edit, to = F.substring("_pair", 1, 1), F.substring("_pair", 2, 1)
    role = F.when(to == "u", "user").when(to == "a", "assistant").otherwise(F.col("role"))
    new = edit == "I"
    kept = edit.isin("K", "R")
    cost = F.when(new, INSERT).when(edit == "D", DELETE).when(edit == "R", REROLE).otherwise(0)
    cost = cost + F.when(kept & (F.col("fault") == "truncated"), TRUNCATED).otherwise(0)
    return rows.select("conv_id", "_first", "_id", "step", F.when(~new, F.col("turn")).alias("turn"), edit.alias("edit"), role.alias("role"),
                       F.when(new, "").otherwise(F.col("text")).alias("text"), cost.cast("long").alias("cost"))


def repair(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Conversations with legal roles: conv_id, place, turn, edit, role, text, cost; deleted rows are left out.

    Rows stand by turn (NULLs first), those of one turn as `in_order` says.  NULL roles and texts are one space, so such rows are
    blank or reroled; a NULL conv_id is a conversation of its own.  Rows repeated in full are duplicates and
    go.  Texts are kept whole, other columns are not read, and an empty table gives no rows.  A conversation
    whose rows are all deleted is absent.  `place` ascends in a conversation, with gaps.
    """
    out = repaired(in_order(conversations), chunk).where("edit <> 'D'")
    return out.select("conv_id", F.struct("_id", "step").alias("place"), "turn", "edit", "role", "text", "cost")


# --- report -----------------------------------------------------------------------------------
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit, cost and digest of each conversation; texts pass through the hash one by one."""
    now, audit, cost, sha, some = None, [], 0, hashlib.sha256(), False

    def made():
        return pa.RecordBatch.from_pydict({
            "_first": pa.array([now], pa.int64()), "audit": pa.array(["".join(audit)], pa.string()), "cost": pa.array([cost], pa.int64()),
            "repaired_sha256": pa.array([sha.hexdigest()], pa.string())})

    for batch in batches:
        names = ("_first", "edit", "role", "text", "cost")
        for first, edit, role, text, price in zip(*[batch.column(n).to_pylist() for n in names]):
            if first != now:
                if now is not None:
                    yield made()
                now, audit, cost, sha, some = first, [], 0, hashlib.sha256(), False
            audit.append(edit)
            cost += price
            if edit != "D":
                sha.update((("\n" if some else "") + f"{role}:{text}").encode())
                some = True
    if now is not None:
        yield made()


def report(conversations: DataFrame, rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Faults, cost, audit and digest of the repair of `rows`, for every conv_id of `conversations`.

    A conversation without rows has zeros, an empty audit and the digest of the empty text.  Its digest reads
    the repaired texts in order, as a digest must, one conversation in one task, without holding them.
    """
    placed = in_order(rows)
    done = repaired(placed, chunk).select("_first", "_id", "step", "edit", "role", "text", "cost")
    done = done.repartition("_first").sortWithinPartitions("_first", "_id", "step").mapInArrow(
        _digests, "_first long, audit string, cost long, repaired_sha256 string")
    initial = F.substring("role", 1, 1)
    left = placed.select("_first", (F.col("_pos") + 1).alias("_pos"), initial.alias("_left"), F.col("turn").alias("_turn"))
    pairs = placed.select("conv_id", "_first", "_pos", "turn", "fault", initial.alias("_i")).join(left, ["_first", "_pos"], "left")
    new_turn = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_turn"))
    wrong = F.col("_left").isNotNull() & ~F.concat("_left", "_i").isin("su", "ua", "au")
    facts = pairs.groupBy("_first").agg(
        F.first("conv_id").alias("conv_id"), (F.max("turn") - F.min("turn") + 1 - F.count_if(new_turn)).alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], F.count_if(wrong).alias("illegal"))
    found = facts.join(done, "_first").drop("_first")
    out = null_safe_join(conversations.select("conv_id").distinct(), found, ["conv_id"], "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return report(rows, damage(rows))
