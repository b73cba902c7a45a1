import re
from collections import Counter, defaultdict

import corpus_pipeline

from . import brute
from .test_native import targets


def test_every_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables, at = [docs], docs
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.cut(stage(spark, at, sf), f"test-{name}")
        tables.append(at)
    rows = [{r["doc_id"]: r for r in t.collect()} for t in tables[:4]]
    assert all(t.columns == docs.columns for t in tables[1:5])
    # all the invented languages are recognised
    assert rows[1].keys() == {k for k, r in rows[0].items() if re.search(r"[^\W\d_]", r["text"] or "")}
    kept = {i for i, _, c in brute.components([(k, r["text"]) for k, r in rows[1].items()]) if i == c}
    assert rows[2].keys() == kept and rows[3].keys() == kept
    changed = [k for k in kept if rows[2][k]["text"] != rows[3][k]["text"]]
    assert changed and all(rows[3][k]["n_chars"] == len(rows[3][k]["text"]) for k in kept)
    for k in kept:
        assert (k in changed) == bool(re.search(r"\S@\S|\d{12}|\d+\.\d+\.\d+\.\d+|\(\d{3}\)|[0-9a-fA-F]{40}", rows[2][k]["text"]))
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows[3].values():
        n = len(brute.words(r["text"]))
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    mixed = tables[4].collect()
    for r in mixed:
        assert r["text"] == rows[3][r["doc_id"]]["text"]
        taken[r["source"]] += len(brute.words(r["text"]))
    for source, aim in targets(sizes).items():
        assert abs(taken[source] - aim) <= 1.5 * largest[source]
    fill, lengths = Counter(), defaultdict(int)
    for r in tables[5].collect():
        fill[r["sequence_id"]] += r["length"]
        lengths[r["doc_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and lengths.keys() == {r["doc_id"] for r in mixed}


def test_run_is_the_stages(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_take_odd_rows(spark, sf):
    rows = [(1, "the of and to that is a", None, None, 1), (1, "the of and to that is a", None, None, 1), (None, "the of and to that", "en", "s", None), (2, None, "en", "s", 0), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").schema)
    sizes = {}
    for table in (docs, docs.where("false")):
        at, sizes[table is docs] = table, []
        for name, stage in corpus_pipeline.STAGES:
            at = corpus_pipeline.cut(stage(spark, at, sf), f"odd-{name}")
            sizes[table is docs].append(at.count())
    # null and empty texts go, of the repeated row one stays, the row without id stays; copies are packed one by one
    assert sizes[False] == [0] * 5 and sizes[True][:3] == [3, 2, 2] and 0 < sizes[True][3] <= 6 and sizes[True][4] == sizes[True][3]


def test_rows_of_one_id_stay_unless_they_repeat(spark, sf):
    words = [" ".join(f"{c}{k}" for k in range(30)) for c in "abc"]
    rows = [(1, words[0], "en", "s", 1), (1, words[1], "en", "s", 2), (1, words[1], "en", "t", 3), (2, words[0], "en", "s", 4), (3, words[2], "en", "s", 5)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").schema)
    kept = corpus_pipeline.near_duplicates(spark, docs, sf).collect()
    assert sorted(tuple(r) for r in kept) == [rows[0], rows[1], rows[4]]
