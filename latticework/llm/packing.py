"""Best-fit-decreasing packing of token pieces into fixed-length sequences.

Lengths are whole numbers up to the capacity, so pieces of one length are
interchangeable and all that best fit needs to know is how many pieces there are
of each length. The plan is made from that histogram on the driver: lengths in
decreasing order, a segment tree over remaining capacities finds the tightest
open bin in logarithmic time, and runs of equal pieces go to runs of equal bins
at once. The plan has a few entries per length whatever the input's size, and it
is the packing that one best-fit-decreasing pass over all pieces would give, with
no loss at partition borders. The pieces themselves never leave the executors:
each gets its rank among the pieces of its length (two-level sums, so a common
length is spread over many tasks) and looks its place up in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean, narrow

CAPACITY = 2048
BUCKETS, BUCKET_ROWS = 64, 50_000
#: Bytes of text encoded at a time.
SLICE = 4 << 20


class Capacities:
    """Segment tree over 0..top: how many open bins have a given remaining capacity."""

    def __init__(self, top: int):
        self.width = 1 << top.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, remaining: int, n: int) -> None:
        at = remaining + self.width
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` that an open bin has."""
        at = least + self.width
        if self.count[at]:
            return least
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at + (not self.count[2 * at])
                return at - self.width
            at >>= 1
        return None


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best fit decreasing of ``lengths[l]`` pieces of each length l.

    Returns rows (length, first rank, pieces, first bin, offset, pieces to a bin):
    piece ``first rank + t`` goes to bin ``first bin + t // per`` at
    ``offset + t % per * length``.
    """
    tree, runs, out, bins = Capacities(capacity), {}, [], 0

    def put(remaining: int, first: int, n: int) -> None:
        if remaining and n:
            runs.setdefault(remaining, []).append((first, n))
            tree.add(remaining, n)

    for length in sorted(lengths, reverse=True):
        rank, left = 0, lengths[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, per = capacity, capacity // length
                first, n = bins, -(-left // per)
                bins += n
            else:
                per = remaining // length
                first, n = runs[remaining].pop()
                tree.add(remaining, -n)
                if (need := -(-left // per)) < n:
                    put(remaining, first + need, n - need)
                    n = need
            pieces = min(left, n * per)
            out.append((length, rank, pieces, first, capacity - remaining, per))
            full, rest = divmod(pieces, per)
            put(remaining - per * length, first, full)
            if rest:
                put(remaining - rest * length, first + full, 1)
            rank, left = rank + pieces, left - pieces
    return np.array(out, dtype=np.int64).reshape(-1, 6)


@lru_cache(maxsize=2)
def encoder(path: str):
    """Token ids of a text as ``tokenizers`` gives them for the file ``path``, no special tokens added.

    Strings of the file's added tokens are matched in plain text. A byte-level
    file's ids are found by tiktoken, some four times as fast, from the same
    vocabulary; what its regular expression can't hold (a million spaces in a
    row) is left to ``tokenizers``, as are all other kinds of file.
    """
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    plain = lambda text: own.encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    kind, model, added = held.get("pre_tokenizer") or {}, held["model"], held.get("added_tokens") or []
    usual = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and not held.get("normalizer")
    bare = all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in added)
    if not usual or not bare or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
        return plain
    # printable bytes stand for themselves, the others for the letters from 256 on
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in same} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in same)}
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    made = [ranks[bytes(byte[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))] for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)):
        return plain
    fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all", disallowed_special=())
        except ValueError:
            return plain(text)

    return ids


def vocabulary() -> str:
    """The vocabulary file that is used if none is named."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Token pieces of ``docs`` (doc_id, text), each of at most ``capacity`` ids.

    A document is its ids and ``end_id``; null and empty texts are ``end_id``
    alone. Longer ones are cut so that all pieces but the first are full.
    Returns doc_id, piece, start, length, ids_crc32 and, if asked, ids.
    """
    path = path or vocabulary()
    narrow(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            held, rows = 0, []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                first = len(ids) % capacity or min(capacity, len(ids))
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc.as_py(), k, a, b - a, zlib.crc32(ids[a:b].tobytes()), *([ids[a:b].astype("i4").tolist()] if with_ids else [])))
                held += len(ids)
                if held > SLICE:
                    yield record(rows)
                    held, rows = 0, []
            yield record(rows)

    types = [pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def record(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack all of ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids.

    Returns the columns of ``pieces`` and sequence_id, offset. Equal rows are
    packed each for itself; null ids are kept; an empty table gives an empty
    result; extra columns are ignored.
    """
    cutted = cut(pieces(docs, path, capacity, end_id, with_ids), "pieces")
    counted = {r["length"]: r["n"] for r in cutted.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = plan(counted, capacity)
    buckets = max(BUCKETS, sum(counted.values()) // BUCKET_ROWS)
    cells = cutted.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    key = ["length", "bucket"]
    over = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.groupBy(*key).agg(F.count("*").alias("n")).select(*key, F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cells.withColumn("rank", rank).join(starts, key).withColumn("rank", (F.col("rank") + F.col("before")).cast("long"))
    names = [*cutted.columns, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = places[:, 0] * (1 << 44) + places[:, 1]
        order = np.argsort(first)
        first, at = first[order], places[order]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = at[np.searchsorted(first, length * (1 << 44) + rank, side="right") - 1]
            t = rank - row[:, 1]
            spots = [row[:, 3] + t // row[:, 5], row[:, 4] + t % row[:, 5] * length]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-2]), *map(pa.array, spots)], names=names)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cutted.schema)
    return ranked.select(*cutted.columns, "rank").mapInArrow(lean(place), f"{fields}, sequence_id long, offset long")
