import random

import pytest

from latticework.llm import neardup

from . import brute


def run(docs):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()), key=str)


def expected(docs):
    return sorted(brute.components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    assert run(docs) == expected(docs)


@pytest.mark.parametrize("one_task", [0, 1000])
def test_chains_of_edits(spark, monkeypatch, one_task):
    """Groups whose members are linked to some of the others only, over several blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "ONE_TASK", one_task)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for group in range(6):
        text = [rng.choice(vocabulary) for _ in range(rng.choice((20, 60, 150)))]
        for _ in range(40):
            own = list(text)
            for _ in range(rng.randint(0, 8)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                text = own
            rows.append((len(rows) * 7 % 241 + 1000 * group, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(docs) == expected(docs)


def test_odd_rows(spark):
    rows = [(3, "a b", "x"), (1, "A  b", "x"), (2, None, "x"), (4, "", "x"), (5, None, "x"), (6, "a b c d e", "x"), (6, "a b c d e", "x"), (7, "A b c d E", None), (9, "Ä b c d e", None), (8, "ä b c d e", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    assert run(docs) == expected(docs)
    loose = spark.createDataFrame([(None, "a b"), (None, None), (1, "a b")], "doc_id long, text string")
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(loose).orderBy("doc_id", "n_shingles").collect()] == [(None, None, True), (None, None, True), (1, 1, True)]
    assert run(docs.where("false")) == []


def test_short_texts_in_a_new_worker(monkeypatch):
    """Texts of fewer words than a shingle, before any power is known."""
    from latticework.llm import fingerprints

    monkeypatch.setattr(fingerprints, "_powers", {})
    assert [len(s) for s in neardup.sets([b"one two", None, b"", b"three"])] == [1, 0, 0, 1]
