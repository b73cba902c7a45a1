import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from latticework.llm import packing


def best_fit(lengths, capacity):
    """One piece at a time into the tightest bin."""
    bins = []
    for n in sorted(lengths, reverse=True):
        open_ = [b for b in bins if b >= n]
        if open_:
            bins.remove(min(open_))
            bins.append(min(open_) - n)
        else:
            bins.append(capacity - n)
    return sorted(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80), st.integers(40, 64))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    places = packing.plan(dict(Counter(lengths)), capacity)
    spans, ranks = defaultdict(list), defaultdict(set)
    for length, rank, n, first, offset, per in places.tolist():
        for t in range(n):
            spans[first + t // per].append((offset + t % per * length, length))
            ranks[length].add(rank + t)
    assert {k: len(v) for k, v in ranks.items()} == Counter(lengths)
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in own) for own in spans.values()) == best_fit(lengths, capacity)


def tokens(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    return [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_round_trip(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = docs.collect()
    ids = dict(zip([r["doc_id"] for r in rows], tokens([r["text"] for r in rows]), strict=True))
    got, sequences, pieces = packing.pack(docs, with_ids=True).collect(), defaultdict(list), defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) <= 2048 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for doc, own in pieces.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == [*range(len(own))] and sum((r["ids"] for r in own), []) == ids[doc]
        assert [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own[:-1]]]).tolist() and all(r["length"] == 2048 for r in own[1:])
    assert pieces.keys() == ids.keys()
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(sequences) == len(best_fit([r["length"] for r in got], 2048))


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a <|endoftext|> b", 0), (3, "a <|endoftext|> b", 0), (None, "x", 0), (4, "word " * 5000, 0), (5, "\x00é日本", 0), (6, "z" * 100_000, 0), (7, "<|endoftext|><|endoftext|>x <|endof", 0), (8, " " * 1_000_000 + "\n" * 1_000_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack(docs, with_ids=True).collect()
    whole = defaultdict(int)
    for r in got:
        whole[r["doc_id"]] += r["length"]
    want = tokens([r[1] for r in rows])
    assert whole == {1: 1, 2: 1, 3: 2 * len(want[2]), None: len(want[4]), 4: len(want[5]), 5: len(want[6]), 6: len(want[7]), 7: len(want[8]), 8: len(want[9])}
    assert len(want[2]) == 5 and want[8][:2] == [50256] * 2
    for doc, ids in zip([r[0] for r in rows], want, strict=True):
        if doc and doc != 3:
            own = sorted((r for r in got if r["doc_id"] == doc), key=lambda r: r["piece"])
            assert sum((r["ids"] for r in own), []) == ids and [r["ids_crc32"] for r in own] == [zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in own]
    assert packing.pack(docs.where("false")).collect() == []
