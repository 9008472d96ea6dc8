"""Operators of runloom.llm against brute force on small tables with nulls, ties, copies and empty texts."""

import hashlib

import numpy as np
import pytest

from runloom.llm import context_mixing, crf_langid, decontaminate, exact_dedup, html_text, line_runs, mixing, near_join, pii, warc
from runloom.llm.common import words_of

LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, LONG, "en", "a"), (2, LONG.upper(), "en", "a"), (3, None, None, "b"), (4, "", "en", None), (5, "short text", "de", "b"),
    (6, LONG + " tail", "de", "a"), (7, "short text", "de", "b"), (8, "x\n" + LONG + "\ny", "en", "c"), (9, "12 345 !", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumnsRenamed({"source": "root"})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact_dedup(spark, docs, none, tmp_path):
    docs.write.parquet(f"{tmp_path}/d")
    got = rows(exact_dedup.exact_dedup(spark, f"{tmp_path}/d"))
    assert (got[1].keep_id, got[1].group_size, got[1].kept) == (2, 2, False)
    assert (got[3].keep_id, got[4].kept) == (4, True)
    assert got[5].text_sha256 == hashlib.sha256(b"short text").hexdigest()
    none.write.parquet(f"{tmp_path}/e")
    assert exact_dedup.exact_dedup(spark, f"{tmp_path}/e").count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(5, 20))), (2, "Short"), (3, None)], "item_id long, text string")
    got = rows(decontaminate.contamination(docs, items))
    assert (got[1].n_words, got[1].n_hit, got[1].n_items) == (60, 15, 1)
    assert (got[5].n_hit, got[3].n_words, got[3].contaminated) == (1, 0, False)
    assert decontaminate.contamination(none, items).count() == 0
    assert not decontaminate.contamination(docs, items.limit(0)).where("contaminated").count()


def test_pii_base_and_disguise():
    base, every = pii.find("mail a.b@c.org, ip 10.0.0.1 card 4111 1111 1111 1111 tel +49 30 1234567")
    assert [len(base[k]) for k in pii.KINDS] == [1, 1, 1, 1] and base == every
    text = "write joe [at] site [dot] org or call plus four nine three zero one two three four five six seven."
    base, every = pii.find(text)
    assert not any(base.values())
    assert [text[a:b] for a, b in every["email"]] == ["joe [at] site [dot] org"]
    assert text[slice(*every["phone"][0])].endswith("six seven")
    assert pii.find("а@b.org")[1]["email"] == [(0, 7)]
    assert not any(pii.find(None)[1].values())
    assert pii.emails("a@b.c_d@e.f") == [(0, 5), (5, 11)]


def test_language(spark, docs, none):
    crf = crf_langid.fit([("the cat and the dog are in the house " * 5, "en"), ("der hund und die katze sind in dem haus " * 5, "de")] * 5)
    got = rows(crf_langid.predict(spark.createDataFrame(
        [(1, "the dog is in the house"), (2, "die katze und der hund"), (3, None), (4, "12 3!")], "doc_id long, text string"), crf))
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "de", "und", "und"]
    assert crf_langid.predict(none, crf).count() == 0
    assert rows(crf_langid.predict(docs, crf_langid.train(none)))[1].lang_pred == "und"


def test_language_sample_counts_copies_once(spark):
    texts = [(" ".join([f"{lang}wort{chr(97 + i)}"] * 5), lang) for lang in ("de", "en", "fr") for i in range(4)]
    copies = spark.createDataFrame(texts, "text string, lang string").crossJoin(spark.range(1000).select("id"))
    crf = crf_langid.train(copies)
    assert crf.labels == ["de", "en", "fr"] and crf.lexicon == {t.split()[0] for t, _ in texts}


def test_language_of_long_runs_of_letters(spark):
    crf = crf_langid.fit([("the cat and the dog are in the house " * 5, "en"), ("der hund und die katze sind in dem haus " * 5, "de")] * 5)
    run = "thedogandthecat" * 4 + "derhundunddiekatze" * 15 + "the"
    assert "".join(crf_langid._words(run)) == run
    got = rows(crf_langid.predict(spark.createDataFrame([(1, run), (2, "x" * 300)], "doc_id long, text string"), crf))
    assert got[1].lang_pred == "de" and got[2].lang_pred in ("de", "en")


def test_html():
    page = ("<html><head><title>t</title></head><body><nav><a href=x>Menu</a></nav><div class='ad'>buy now</div><article><h1>Head</h1>"
            "<p>The body of &amp; text<br>more\n text</p><div class=comments>bad</div></article><footer>&copy; x</footer></body></html>")
    assert html_text.main_text(page) == "Head The body of & text more text"
    assert html_text.main_text(None) == "" and html_text.main_text("<p") == ""


def test_mixing(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 0, 1), (99, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, labels)
    assert got.count() == len(ROWS) and not got.where("rate < 0 OR rate > 4").count()
    assert abs(got.selectExpr("sum(p_good + p_poor + p_toxic)").first()[0] - len(ROWS)) < 1e-6
    assert mixing.mix(none, labels).count() == 0 and mixing.mix(docs, labels.limit(0)).count() == len(ROWS)


def test_lines(spark, none):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    table = spark.createDataFrame([(1, f"{a}\n{b}\n{c}"), (2, f"own\n{a}\n{b}\nend"), (3, f"{c}\nelse"), (4, None), (5, "")], "doc_id long, text string")
    got = rows(line_runs.dedup_lines(table))
    assert got[1].n_deleted == 0 and got[2].text == "own\nend" and got[3].n_deleted == 0
    assert got[4].text is None and got[5].text == ""
    assert line_runs.dedup_lines(none).count() == 0


def repeated_lines(texts, min_words=50):
    """Lines each text keeps, by the longest match of every place with any earlier place."""
    docs = [[(i, " ".join(line.split())) for i, line in enumerate(t.split("\n")) if line.split()] for t in texts]
    places = [(d, p) for d, lines in enumerate(docs) for p in range(len(lines))]
    gone = set()
    for n, (d, p) in enumerate(places):
        most = 0
        for e, q in places[:n]:
            k = 0
            while p + k < len(docs[d]) and q + k < len(docs[e]) and docs[d][p + k][1] == docs[e][q + k][1]:
                k += 1
            most = max(most, k)
        if most and sum(len(docs[d][p + k][1].split()) for k in range(most)) >= min_words:
            gone |= {(d, i) for i in range(docs[d][p][0], docs[d][p + most - 1][0] + 1)}
    return ["\n".join(line for i, line in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in enumerate(texts)]


def test_lines_with_a_partial_earlier_copy(spark):
    five = [" ".join(f"{k}{i}" for i in range(10)) for k in "abcde"]
    texts = ["\n".join(five[:4]), "\n".join(five), "own\n" + "\n".join(five) + "\nend"]
    got = rows(line_runs.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert got[1].n_deleted == 0 and got[2].text == "own\nend" and got[2].n_deleted == 5


def test_lines_against_longest_earlier_matches(spark):
    draw = np.random.default_rng(3)
    pool = [" ".join(f"{k}{i}" for i in range(n)) for k, n in zip("abcdefg", (1, 2, 3, 5, 7, 12, 30), strict=True)]
    texts = ["\n".join([*(pool[j] if j < 7 else "" if j == 7 else f"own {n}" for j in draw.choice(9, 25, p=[.14] * 7 + [.01] * 2)), *[pool[0]] * (n % 9)])
             for n in range(60)]
    for least in (1, 12, 20):
        got = rows(line_runs.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), least))
        assert [got[n].text for n in range(60)] == repeated_lines(texts, least)


def test_warc():
    meta, text = warc.derivatives(7, "http://a/\nb", "<p>The of and to " * 20)
    assert meta[2] == "metadata" and text[2] == "conversion" and meta[4] == text[4] and text[5] == meta[3]
    assert text[6] == warc.digest(text[10].encode()) and b"WARC-Refers-To: " + text[4].encode() in text[11]
    assert len(warc.derivatives(1, None, None)) == 2


def test_near_duplicates(docs, none):
    got = rows(near_join.near_duplicates(docs))
    sets = {r[0]: set(near_join.shingle_set(words_of(r[1]), decontaminate._Ids()).tolist()) for r in ROWS}
    for i, s in sets.items():
        linked = [j for j, t in sets.items() if j != i and s and t and len(s & t) >= 0.8 * len(s | t)]
        assert got[i].n_links == len(linked) and all(got[j].class_id == got[i].class_id for j in linked)
    assert near_join.near_duplicates(none).count() == 0


def test_blocks_split_large_groups(docs, monkeypatch):
    whole = rows(near_join.near_duplicates(docs))
    monkeypatch.setattr(near_join, "BLOCK_ROWS", 1)
    assert rows(near_join.near_duplicates(docs)) == whole


def test_language_model(docs, none):
    got = rows(context_mixing.score(docs, docs))
    assert (got[3].n_tokens, got[1].n_tokens, got[1].n_known) == (1, 61, 61)
    assert all(r.score < 0 and r.base_score < 0 for r in got.values())
    assert rows(context_mixing.score(docs, none))[1].n_known == 0
    assert context_mixing.score(none, docs).count() == 0


def test_language_model_slots_do_not_depend_on_neighbours():
    texts = [f"word{i} other text of {i} parts".encode().split() for i in range(5)] + [[], [b"x" * 40] * 4000]
    bodies = [context_mixing.coded(w) for w in texts]

    def found(some):
        parts = [context_mixing.slots(body, counted, 14)[0] for body, counted, _ in context_mixing.buffers(iter(some))]
        return np.concatenate([np.stack(p) for p in parts], axis=2)

    together = found(bodies)
    assert np.array_equal(together, np.concatenate([found([b]) for b in bodies], axis=2))
    assert together.shape[2] == sum(map(len, bodies))


def test_language_model_tables_hold_the_counts(spark):
    texts = ["the cat sat on the mat", "the dog sat", "", None, "the cat sat on the mat"] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    stretch, seen = context_mixing.model_tables(context_mixing.bit_counts(docs, 12, 100), 12)
    counts = np.zeros((context_mixing.CONTEXTS, 1 << 12, 2))
    for t in texts:
        body = context_mixing.coded(context_mixing.tokens(t))
        for one, counted, _ in context_mixing.buffers(iter([body])):
            index, bit = context_mixing.slots(one, counted, 12)
            for k, rows_of in enumerate(index):
                for slot, b in zip(rows_of.ravel(), bit.ravel(), strict=True):
                    counts[k, slot, b] += 1
    assert np.array_equal(seen, np.minimum(counts.sum(axis=2), 255))
    wanted = np.log((counts[:, :, 1] + context_mixing.PRIOR) / (counts[:, :, 0] + context_mixing.PRIOR)) * context_mixing.SCALE
    assert np.array_equal(stretch, np.clip(np.round(wanted), -127, 127))


def test_language_model_learns(spark):
    texts = [" ".join(f"{a}{(i * 7 + j) % 11}" for j, a in enumerate("ab ac ad ae af ag".split() * 5)) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = context_mixing.score(docs.where("doc_id % 4 = 0"), docs.where("doc_id % 4 != 0"))
    assert got.where("score < base_score").count() == 0 and got.where("bits_per_byte >= 1").count() == 0


def test_starting_weights_read_every_training_row(spark, monkeypatch):
    """Any of 300 rows changes the weights, however the rows are dealt out to parts."""
    data = [(i, f"word{i % 7} of row {i}") for i in range(300)]
    tables = spark.createDataFrame(data, "doc_id long, text string")
    shared = spark.sparkContext.broadcast(context_mixing.model_tables(context_mixing.bit_counts(tables, 12, 5000), 12))
    monkeypatch.setattr(context_mixing, "SHARE", 1 << 11, raising=False)
    whole = context_mixing.start_weights(tables, shared, 12, 5000)
    hashes = {r.doc_id: r.h for r in tables.selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    last = max(hashes, key=hashes.get)
    assert np.allclose(whole, context_mixing.start_weights(tables.repartition(3), shared, 12, 5000), atol=1e-6)
    assert not np.allclose(whole, context_mixing.start_weights(tables.where(f"doc_id <> {last}"), shared, 12, 5000), atol=1e-6)


def test_language_model_joins_rare_tokens_only(spark, docs, monkeypatch):
    """A text stores one row and its rare tokens; where counts are met, in the task or in the join, changes no sum."""
    data = [(i, t) for i, t in enumerate(["a b c d e", "a b b c", "", None, "new words a", "b a c"] * 3)]
    texts, stored = spark.createDataFrame(data, "doc_id long, text string"), {}
    keep = context_mixing.stored
    monkeypatch.setattr(context_mixing, "stored", lambda df, name: stored.setdefault(name, []).append(keep(df, name)) or stored[name][-1])
    train = texts.where("doc_id % 6 <> 4")
    got = []
    for most in (1 << 19, 3, 0):
        monkeypatch.setattr(context_mixing, "COMMON", most, raising=False)
        got.append(rows(context_mixing.score(texts, train)))
    # "new" and "words" are not known; of the others the three commonest at most are held.
    assert [t.count() for t in stored["tokens"]][0] == len(data) + 2 * 3
    for other in got[1:]:
        for key, r in got[0].items():
            assert (r.n_tokens, r.n_known, r.train_tokens) == (other[key].n_tokens, other[key].n_known, other[key].train_tokens)
            assert r.base_score == pytest.approx(other[key].base_score, rel=1e-12) and r.score == pytest.approx(other[key].score, rel=1e-9)
    assert (got[0][4].n_tokens, got[0][4].n_known) == (4, 2)


def test_counts_lacking_a_bit_are_looked_up():
    lack, bit = context_mixing._lacking(), np.array([0, 1] * 300)
    stretch, seen = np.arange(600).astype(np.uint8).view(np.int8), (np.arange(600) * 7 % 256).astype(np.uint8)
    at = stretch.view(np.uint8).astype(int) << 9 | seen.astype(int) << 1 | bit
    assert np.array_equal(lack[at], context_mixing._without(stretch, seen, bit))


def test_mixing_counts_capitals_by_one_split(spark):
    """A replacement beside the splits of one text took as long as all of them."""
    texts = ["", None, "Abc DEF", "ÄÖ x", "no", "ZZZ", "a\U0001F600B"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = mixing._features(docs)
    assert "regexp_replace" not in found._jdf.queryExecution().executedPlan().toString()
    # More than half of "Abc DEF" are capitals; texts of one word name no shares.
    for number, word in ((2, "=capitals=7"), (5, "=capitals=7"), (4, "=capitals=0")):
        bucket = spark.sql(f"SELECT cast(pmod(xxhash64('{word}'), {mixing.BUCKETS}) AS int)").first()[0]
        assert (bucket in rows(found)[number].buckets) == (number == 2)


def test_mixing_splits_texts_once_and_shuffles_none(spark, docs):
    """Texts are read by the table of buckets alone, whatever the size of the labels."""
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    read = []
    held = mixing.stored

    def spy(df, name):
        read.append((name, any(c == "text" for leaf in df._jdf.queryExecution().optimizedPlan().collectLeaves().mkString().split() for c in [leaf.strip("[],").split("#")[0]])))
        return held(df, name)

    mixing.stored = spy
    try:
        mixing.mix(docs, labels).count()
    finally:
        mixing.stored = held
    assert [name for name, text in read if text] == ["features"]


def test_mixing_finds_form(spark):
    good = [(i, f"plain words number {i} stand here. and more of them follow", 1) for i in range(40)]
    poor = [(100 + i, f"LOUD!! WORDS!! NUMBER{i}!! STAND!! HERE!!", 0) for i in range(40)]
    table = spark.createDataFrame(good + poor, "doc_id long, text string, quality int")
    labels = table.selectExpr("doc_id", "quality", "0 AS toxic").where("doc_id % 2 = 0")
    got = rows(mixing.mix(table, labels))
    assert all(got[i].domain == ("poor" if i >= 100 else "good") for i in got)
