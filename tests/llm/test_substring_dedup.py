import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from latticework.llm import substring_dedup

from . import brute


def run(docs, **more):
    rows = substring_dedup.dedup(docs, **more).withColumn("sha", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["sha"]) for r in rows), key=str)


def expected(docs, width=50):
    return sorted(brute.dedup([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], width), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    assert run(docs) == expected(docs)


def test_full_sketch_loses_nothing(spark, sf, monkeypatch):
    """A sketch with hardly any cells passes every window; the result is the same."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(substring_dedup, "LEAST_BITS", 10)
    assert run(docs, most_bits=10) == expected(docs)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(120))
    again = " ".join(["a", "b", "c"] * 60)
    rows = [(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, text + " tail", None), (4, text + " tail", None), (None, text, "x"), (None, None, None), (5, " a\x1cb c", "x"), (6, again, "x"), (7, again, "x"), (0, " \t\n", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash string")
    assert run(docs) == expected(docs)
    assert run(docs, width=7) == expected(docs, 7)
    assert run(docs.where("false")) == []


def test_hot_anchors_are_dealt_out(spark, monkeypatch):
    """Many distinct windows around one phrase: their bucket is split, and nothing is lost or found twice."""
    monkeypatch.setattr(substring_dedup, "BUCKET", 40)
    rnd = random.Random(4)
    middle = "one phrase that all share".split()
    own = [[f"w{rnd.randrange(10**6)}" for _ in range(120)] for _ in range(30)]
    texts = [" ".join([*w[:60], *middle, *w[60:]]) for w in own]
    texts += [" ".join([*w[:70], *middle, *w[70:]]) for w in own[:5]] + [" ".join([*own[k][20:60], *middle, *own[k][60:100]]) for k in range(0, 30, 3)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.dedup(docs).collect()}
    assert got == brute_removed(texts)
    assert sum(n for _, n, _ in got.values()) > 500


def brute_removed(texts, width=50):
    first = {}
    words = [t.split() for t in texts]
    for k, w in enumerate(words):
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), k)
    out = {}
    for k, w in enumerate(words):
        gone = {p for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < k for p in range(i, i + width)}
        out[k] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


def test_workers_hold_little():
    """Two million windows of a slice or a bucket take a worker a small multiple of their hashes, and rows go on in small batches."""
    rng = np.random.default_rng(3)
    n, each, docs = 100_000, 20, 500
    h = rng.integers(0, 1 << 63, n * each // 2, dtype=np.uint64)
    anchor = rng.integers(0, 1 << 63, n // 2, dtype=np.uint64)
    doc = np.arange(n) // (n // docs)
    runs = (doc, np.arange(n) % (n // docs) * each, np.full(n, each), np.tile(anchor, 2), np.tile(h, 2))
    ids = [(docs - k, k) for k in range(docs)]
    tracemalloc.start()
    batches, sent, late = 0, 0, 0
    for rows in substring_dedup._entries([runs], list(ids), 3):
        batches += 1
        assert sum(len(r[6] or b"") for r in rows) < 8e6
        sent += sum(len(r[6] or b"") // 8 for r in rows)
        late += sum(int(np.frombuffer(r[7], "<i4").reshape(-1, 2)[:, 1].sum()) for r in rows if r[0] is None)
        assert all(r[1] > docs // 2 for r in rows if r[0] is None) and all(r[1] <= docs // 2 for r in rows if r[0] is not None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent == late == n * each // 2 and batches > 1 and peak < 140e6
    step = n // docs
    part = pd.DataFrame([(*ids[k], *(c[k * step : (k + 1) * step].astype(t).tobytes() for c, t in zip(runs[1:4], ("<i4", "<i4", "<u8"), strict=True)), runs[4][k * step * each : (k + 1) * step * each].tobytes()) for k in range(docs)], columns=["doc_id", "text_hash", "place", "n", "anchor", "hashes"])
    tracemalloc.start()
    out = substring_dedup._settled(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(int(np.frombuffer(s, "<i4").reshape(-1, 2)[:, 1].sum()) for _, _, s in out) == late and {i for i, _, _ in out} == set(range(docs // 2 + 1, docs + 1))
    assert peak < 140e6
