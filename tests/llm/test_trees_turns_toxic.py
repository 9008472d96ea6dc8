"""Merkle manifest, conversation repair and toxicity against brute force on small awkward tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.llm import conversations, merkle, toxicity
from tests.llm import brute_conversations as plain

# --- Merkle manifest --------------------------------------------------------------------------
LONG = "line of a very long text\n" * 20_000
DOCS = [
    (1, "a", "s", "en", 1), (2, "b", None, "en", 1), (3, None, "s", "en", None), (4, "", "s", "en", 0), (5, "ü", "s", "en", 1),
    (5, "ü", "s", "en", 1), (5, "other", "s", "en", 5), (None, "no id", "s", "en", 5), (None, None, None, None, None), (9, LONG, "s", None, len(LONG)),
    (7, "x", "s", "de", 1), (8, "one", "s", "fr", 3), (14, "y", "s", "ÿ", 1), (21, "z", "s", "\U0001f600", 1), (28, "z", "s", "", 1),
] + [(i, f"text {i}", "s", "es", 6) for i in range(100, 137)]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    doc_id, text, source, lang, n_chars = row
    values = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return digest(*values)


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_manifest(rows):
    langs = sorted({r[3] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[3] == lang), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[lang] = own, plain_levels([plain_leaf(r) for r in own])
    crown = plain_levels([trees[v][1][-1][0] for v in langs])
    out = []
    for rank, lang in enumerate(langs):
        own, levels = trees[lang]
        for place, r in enumerate(own):
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node, proof = plain_leaf((*r[:4], r[4] + 1) if bad else r), []
            for tree, at in ((levels, place), (crown, rank)):
                for level in tree[:-1]:
                    run = level[at // 2 * 2:at // 2 * 2 + 2]
                    proof += [x for i, x in enumerate(run) if i != at % 2]
                    run[at % 2] = node
                    node, at = digest(*run), at // 2
            out.append((r[0], plain_leaf(r), levels[-1][0], crown[-1][0], digest(*proof), node, node == crown[-1][0]))
    return out


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_manifest_equals_plain_trees(spark, bits):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string, lang string, n_chars long").withColumn("_first", F.lit("clash"))
    bad = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    got = merkle.manifest(docs, F.when(bad, F.col("n_chars") + 1).otherwise(F.col("n_chars")), bits).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_manifest(DOCS)))
    assert {r.verified for r in got} == {True, False}


def test_manifest_paths_and_empty_table(spark):
    docs = spark.createDataFrame(DOCS[:7], "doc_id long, text string, source string, lang string, n_chars long")
    for r in merkle.manifest(docs, with_paths=True).collect():
        node = r.leaf
        for s in r.path.split():
            node = merkle.step(node, s)
        assert node == r.root and r.verified
    assert merkle.manifest(docs.limit(0)).collect() == []
    one = merkle.manifest(docs.limit(1)).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == digest()


# --- conversation repair ----------------------------------------------------------------------
def some_rows(seed=5):
    rnd, rows = random.Random(seed), []
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    for conv in [*range(60), None]:
        for i in range(rnd.choice([1, 2, 3, 5, 8, 13, 40])):
            text = rnd.choice([None, "", " ", "Hi.", "Ok", "What?", "Yes!", f"text {rnd.randint(0, 9)}.", "\t x \n", "a. ", "b. "])
            rows.append((conv, rnd.choice([None, i, i, i + 1]), rnd.choice(roles), text))
    rows += [(500, 0, "user", "Long. " * 100_000), (500, 1, "assistant", "Long " * 100_000)]
    return rows


@pytest.mark.parametrize("chunk", [3, 8192])
def test_report_equals_plain_search(spark, chunk):
    rows = some_rows()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_id", F.lit("clash"))
    got = {r.conv_id: r.asDict() for r in conversations.report(table, conversations.damage(table), chunk).collect()}
    want = plain.report(rows)
    assert set(got) == set(want)
    assert all(got[c] == {"conv_id": c, **want[c]} for c in want)


def test_repaired_rows_and_empty_table(spark):
    rows = [("x", 0, "assistant", "Hello."), ("x", 1, "assistant", "Hello."), ("x", 2, "assistant", "Yes."), ("y", 0, "user", "")]
    table = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = conversations.repair(table).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.edit, r.role, r.text) for r in got] == [("x", "R", "user", "Hello."), ("x", "K", "assistant", "Yes.")]
    assert conversations.repair(table.limit(0)).collect() == []
    assert conversations.report(table.limit(0), table.limit(0)).collect() == []
    gone = conversations.report(table, table.limit(0)).orderBy("conv_id").collect()
    assert [(r.conv_id, r.cost, r.audit, r.repaired_sha256) for r in gone] == [(c, 0, "", hashlib.sha256().hexdigest()) for c in "xy"]


def test_blocks_agree_with_single_steps():
    rnd = random.Random(1)
    for _ in range(300):
        symbols = bytes(rnd.randrange(9) for _ in range(rnd.randint(1, 30)))
        vectors, exits = conversations.effect(symbols)
        at = rnd.randrange(len(vectors))
        for state in range(4):
            assert conversations.trace(symbols, at, state)[1] == exits[at, state]
        v = at
        for s in reversed(symbols):
            v = conversations.tables().before1[v, s]
        assert v == vectors[at]


# --- toxicity ---------------------------------------------------------------------------------
def test_fold():
    assert toxicity.fold("You ARE a Cl0wn, m­oron! іd1оt 7th p@ss 2024") == " you are a clown moron idiot tth pass 2024 "
    assert toxicity.fold(None) == toxicity.fold("") == toxicity.fold(" \n.") == " "
    assert toxicity.fold("1" * 50_000).strip() == "1" * 50_000


def test_longest_entry_and_exceptions():
    model = toxicity.Model({" clown": 2.0, " clowns ": 3.0, " mor": 1.0}, frozenset({" clown fish ", " a moron "}))
    assert [p for _, p in model.hits(toxicity.fold("clown clowns CLOWN FISH, clownish; a moron more"))] == [" clown", " clowns ", " clown", " mor"]
    assert toxicity.Model({}).hits(" any text ") == []


def naive_hits(model, folded):
    out = []
    for i, c in enumerate(folded):
        if c == " ":
            fits = [p for p in model.entries if folded.startswith(p, i)]
            spared = [(j, j + len(e)) for e in model.exceptions for j in range(len(folded)) if folded.startswith(e, j)]
            if fits:
                p = max(fits, key=len)
                if not any(a <= i and i + len(p) <= b for a, b in spared):
                    out.append((i, p))
    return out


def test_hits_equal_naive_search():
    rnd = random.Random(2)
    words = ["ab", "abc", "abcd", "xyz", "xy", "abx"]
    for _ in range(200):
        entries = {" " + rnd.choice(words) + rnd.choice(["", " "]): 1.0 for _ in range(3)}
        exceptions = frozenset(f" {rnd.choice(words)} {rnd.choice(words)} " for _ in range(2))
        model = toxicity.Model(entries, exceptions)
        folded = " " + "".join(rnd.choice(words) + " " for _ in range(30))
        assert model.hits(folded) == naive_hits(model, folded)


def labelled(spark):
    rnd = np.random.default_rng(7)
    plain_words = [f"w{i}" for i in "abcdefghijklmnopqrst"]
    rows, marks = [], []
    for i in range(400):
        words = list(rnd.choice(plain_words, 30))
        toxic = i % 4 == 0
        words += ["stupid", "Mor0n"] if toxic else ["stupid", "question"] if i % 7 == 0 else []
        rows.append((i, " ".join(words), "label"))
        marks.append((i, int(toxic)))
    rows += [(900, None, "x"), (901, "", "x"), (902, "mоrоn " + "wa " * 50_000, "x"), (903, "You are a MORON", "x"), (904, "stupid question", "x"),
             (904, "stupid question", "x")]
    marks += [(1, None), (None, 1), (3, 0), (3, 0), (12_345, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame(marks, "doc_id long, toxic int")


def test_learned_lexicon_and_exceptions(spark):
    docs, marks = labelled(spark)
    model = toxicity.fit(docs, marks)
    assert " moron" in model.entries and " stupid question " in model.exceptions
    out = toxicity.toxicity(docs, model)
    assert out.columns == ["doc_id", "text", "score", "entries"] and out.count() == docs.count()
    got = {r.doc_id: r for r in out.collect()}
    assert got[903].score > 0.5 > got[904].score and got[904].entries == []
    assert got[900].score == got[901].score < 0.5
    assert got[902].entries == ["moron"]
    assert all((got[i].score >= 0.5) == (i % 4 == 0) for i in range(400))


def test_one_label_or_none(spark):
    docs, marks = labelled(spark)
    for some in (marks.where("toxic = 0"), marks.limit(0)):
        model = toxicity.fit(docs, some)
        assert not model.entries
        assert all(0 <= r.score <= 1 for r in toxicity.toxicity(docs, model).select("score").collect())
    assert toxicity.toxicity(docs.limit(0), model).collect() == []
