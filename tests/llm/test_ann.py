import math
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm import ann


def exact(rows, k=5, every=50):
    out = {}
    usable = {i: np.array(v, dtype=float) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    for q, v in usable.items():
        if q % every == 0:
            scored = [(-float(v @ u / math.sqrt(v @ v) / math.sqrt(u @ u)), i) for i, u in usable.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in scored)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("sf,least", [("sf0.01", 1.0), ("sf0.1", 0.9)])
def test_recall(spark, sf, least):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    want, got = exact([(r["vec_id"], r["embedding"]) for r in table.collect()]), found(ann.search(table, entries_least=100 if least < 1 else ann.ENTRIES))
    assert want.keys() == got.keys()
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= least * sum(map(len, want.values()))
    scores = {q: dict(v) for q, v in want.items()}
    assert all(abs(s - scores[q].get(i, s)) < 1e-12 for q in got for i, s in got[q])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0]), (None, [1.0, 1.0]), (50, [0.0, 3.0]), (100, None)]
    rows += [(i, [1.0, 1.0]) for i in range(200, 240)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, cell string")
    got = found(ann.search(table))
    want = exact([r for r in rows if r[1] is None or len(r[1]) == 2])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert ann.search(table.where("false")).collect() == []
    assert ann.search(table.where("vec_id = 0")).collect() == []


def test_index_is_not_exhaustive(spark):
    """With clusters a few per cent of the entries do; without, the walk ends at the share."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 32))
    rows = [(i, (centres[i % 60] + 0.15 * rng.normal(size=32)).astype("f4").tolist()) for i in range(6000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want, got = exact(rows), found(ann.search(table, entries_least=100))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    x = np.array([v for _, v in rows], dtype="f4")
    unit = ann.units(x.tobytes(), 32, "<f4")
    books = ann.Codebooks([ann.kmeans(unit[:, :16], 32), ann.kmeans(unit[:, 16:], 32, 1)], 32)
    counts, near = np.zeros((32, 32), dtype=np.int64), books.distances(unit)
    np.add.at(counts, tuple(books.cells(unit)), 1)

    def looked_at(near):
        reach = [ann.walk([d[i] for d in near], counts, 100, 2400) for i in range(0, len(near[0]), 50)]
        a, b = books.cells(unit)
        return [int(((near[0][i * 50][a] + near[1][i * 50][b]) <= r).sum()) for i, r in enumerate(reach)]

    seen = looked_at(near)
    assert np.mean(seen) < 0.1 * len(rows) and min(seen) >= 100


def test_driver_holds_little(spark):
    """neither all rows' distances to the centroids nor every task's own sample are held at once, and the sample is the same."""
    x = np.random.default_rng(2).normal(size=(20_000, 4))
    tracemalloc.start()
    centres = ann.kmeans(x, 1024, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert centres.shape == (1024, 4) and peak < 64e6
    entries = spark.range(0, 20_000, 1, 16).select(F.encode(F.col("id").cast("string"), "utf-8").alias("raw"))
    want = [r["raw"] for r in entries.orderBy(F.xxhash64("raw")).limit(300).collect()]
    found = ann.sampled(entries, 20_000, 300)
    assert [r["raw"] for r in found.collect()] == want
    passed = [int(x) for x in re.findall(r"<= (-?\d+)", found._jdf.queryExecution().optimizedPlan().toString())]
    assert passed and entries.where(F.xxhash64("raw") <= passed[0]).count() < 900
    assert len(ann.sampled(entries, 20_000, 30_000).collect()) == 20_000


def test_copies_of_queries_are_not_broadcast(spark, monkeypatch):
    """The queries of a group are copied for every part that compares them; a broadcast would bring all copies to the driver."""
    monkeypatch.setattr(ann, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype("f4").tolist()) for i in range(600)]
    df = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    want, got = exact(rows), found(df)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    df.collect()
    joins = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "group#" in line]
    assert joins and not any("Broadcast" in line and "part#" in line for line in joins), joins
