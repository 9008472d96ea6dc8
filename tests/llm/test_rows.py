"""Rows with null or repeated doc_id, clashing columns and repeats, through the operators that keep rows apart by their text."""

import pytest

from runloom.llm import crf_langid, decontaminate, near_join

BODY = " ".join(f"w{i}" for i in range(60))
OTHER = " ".join(f"v{i}" for i in range(40))
ITEM = " ".join(f"w{i}" for i in range(12))
ROWS = [(None, BODY, "a"), (None, OTHER, "b"), (7, BODY, "c"), (7, "five quite other words here", "d"), (7, BODY, "c"), (8, None, "e"), (8, None, "e"), (9, "", "f"),
        (2**60 + 1, BODY + " tail", "g")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, row string").repartition(3)


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_contamination_by_row(spark, docs):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = decontaminate.contamination(docs, items)
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"]) for r in got.collect()) == [
        (0, 40, 0), (0, 60, 12), (7, 5, 0), (7, 60, 12), (7, 60, 12), (8, 0, 0), (8, 0, 0), (9, 0, 0), (2**60 + 1, 61, 12)]
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and pairs(kept, "row") == [("b",), ("d",), ("e",), ("e",), ("f",)]


def test_near_duplicates_by_row(docs):
    got = near_join.near_duplicates(docs)
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"], r["copies"]) for r in got.collect()) == [
        (0, 0, 0, 1), (0, 7, 3, 3), (7, 7, 0, 1), (7, 7, 3, 3), (7, 7, 3, 3), (8, 8, 0, 1), (8, 8, 0, 1), (9, 9, 0, 1), (2**60 + 1, 7, 3, 1)]
    kept = near_join.one_per_class(docs)
    assert kept.columns == docs.columns and pairs(kept, "row") == [("b",), ("c",), ("d",), ("e",), ("e",), ("f",)]
    assert near_join.one_per_class(docs.limit(0)).count() == 0


def test_class_of_rows_without_doc_id(spark):
    docs = spark.createDataFrame([(None, BODY), (None, BODY.upper()), (None, BODY + " x")], "doc_id long, text string")
    assert [(r["class_id"], r["n_links"]) for r in near_join.near_duplicates(docs).collect()] == [(None, 2)] * 3
    assert near_join.one_per_class(docs).count() == 1


def test_mixed_languages_are_identified(spark):
    parts = {"en": "the dog is in the house and the cat", "de": "der hund und die katze sind im haus", "es": "el perro y los gatos para una casa"}
    learned = [(i, text, lang) for i, (lang, text) in enumerate(list(parts.items()) * 20)]
    mixed = [(None, " ".join(parts.values()), None), (500, "", None), (500, "12 3 !", None), (500, parts["en"], None)]
    docs = spark.createDataFrame(learned + mixed, "doc_id long, text string, lang string")
    kept = crf_langid.keep_identified(docs)
    assert kept.count() == len(learned) + 2 and kept.where("doc_id IS NULL").count() == 1
    assert crf_langid.keep_identified(docs.limit(0)).count() == 0
