import random
import tracemalloc

import numpy as np
import pytest

from latticework.llm import langid, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op8_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 10_000 and len(held) > 2000
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.995
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["rejected"] for r in held if r["score"] > 0]) < 0.0005


def test_rejects_what_is_far(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    odd = [(1, None, None), (2, "", "en"), (3, "12 34 !!", "en"), (4, "Съешь же ещё этих мягких французских булок, да выпей чаю " * 5, "ru"), (5, "the and of that", None), (5, "the and of that", None), (6, "the of and " * 100_000, None)]
    got = langid.identify(spark.createDataFrame(odd, "doc_id long, text string, score string"), model).orderBy("doc_id").collect()
    assert [(r["lang_pred"], r["rejected"]) for r in got[:3]] == [("und", True)] * 3
    assert got[3]["rejected"] and got[3]["lang_pred"] in ("en", "fr", "de", "es")
    assert [(r["lang_pred"], r["rejected"]) for r in got[4:6]] == [("en", False)] * 2 and got[6]["lang_pred"] == "en"
    assert langid.identify(docs.where("false"), model).collect() == []


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "the text", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert [(r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()] == [("und", 0.0)]


def test_counts_in_blocks(monkeypatch):
    folded = langid.letters("Some letters, not so many, ÄÖÜ. " * 40)
    whole = langid.counts(folded)
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert (langid.counts(folded) == whole).all() and whole.sum() == sum(len(folded) - n for n in range(langid.GRAMS))


FOREIGN = {
    "it": "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. Tutti gli esseri umani nascono liberi ed eguali in dignita e diritti.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
}


@pytest.mark.parametrize("at", ["sf0.001", "sf0.1"])
def test_rejects_foreign_words_in_latin_script(spark, at):
    """Foreign prose and random letters, long and short, go; held-out rows stay."""
    rnd = random.Random(5)
    noise = [" ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(n)) for n in (3, 80, 2000)]
    odd = [*FOREIGN.values(), *(t[:60] for t in FOREIGN.values()), *(t * 20 for t in FOREIGN.values()), *noise]
    docs = spark.read.parquet(f"/root/testdata/{at}/documents.parquet").select("doc_id", "text", "lang").withColumn("held", queries._held_out())
    model = langid.fit(docs.where("not held"))
    found = [model.predict(t) for t in odd]
    assert all(rejected for _, _, rejected in found), [(t[:30], f) for t, f in zip(odd, found, strict=True) if not f[2]]
    clean = [t for t in (r["text"] for r in docs.where("held").collect()) if langid.letters(t)]
    assert np.mean([model.predict(t)[2] for t in clean]) < 0.0005


def test_letters_are_category_l(spark, sf):
    """Numerals that look like letters are none; fits count only rows that have a text."""
    assert [langid.letters(t) for t in ("½ ² ① Ⅷ", "٣ ③", "½", "_ 12 !")] == [b""] * 4
    assert all(langid.letters(t) for t in ("ª", "中", "½ a", "ʰ"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    nulls = spark.range(20_000).selectExpr("id + 1000000 as doc_id", "cast(null as string) as text", "'en' as lang")
    assert (langid.fit(docs).centroids == langid.fit(docs.unionByName(nulls)).centroids).all()
    odd = spark.createDataFrame([(1, "½ ² ① Ⅷ", "own", "Own")], "doc_id long, text string, _language string, __language string")
    got = langid.identify(odd, langid.fit(docs)).first()
    assert (got["_language"], got["__language"], got["lang_pred"], got["score"], got["rejected"]) == ("own", "Own", "und", 0.0, True)


def test_a_filter_does_not_predict_again(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = langid.identify(docs, langid.fit(docs)).where("not rejected").select("doc_id", "lang_pred")
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython ") == 1
    assert 0 < kept.count() <= docs.count()


def test_fit_holds_little(spark):
    """The driver holds the vectors of one language at a time, not of all of them three times over."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    tracemalloc.start()
    model = langid.fit(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(model.langs)) == 4 and peak < 80e6
