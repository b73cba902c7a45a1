"""Removal of word windows that occur in an earlier document.

First pass: every window of ``width`` words is counted under its anchor, the
least hash of the short word groups inside it. Equal windows have equal anchors,
so an anchor's count of documents is never below that of any of its windows, and
neighbouring windows share an anchor, so there are some twenty times fewer
anchors than windows to count. Counts are kept in count-min sketches, one for a
slice of the input, merged by blocks of cells; the cells with two or more
documents go to the tasks as bitmaps whose size is bounded by a parameter.

Second pass: only windows whose anchor is estimated to be repeated are grouped,
by anchor and window hash (128 bits), to find the least doc_id of each. Within a
slice of the input only the least document's windows are sent on; the others are
already known to be repeats. So a window that a third of all documents share
sends one entry from each slice, and every bucket of anchors is bounded by its
share of the windows. Overestimates cost work, never results: no window is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, cut, lean, light, narrow, trim
from .fingerprints import mixed, sliding_min, split_all, windows, word_hashes

#: Words of a window; words of the groups of which the least is the anchor.
WIDTH, GROUP = 50, 5
#: Rows of the sketch, cells for a word of the input, least and most cells (as powers of two).
ROWS, CELLS_PER_WORD, LEAST_BITS, MOST_BITS = 2, 0.5, 16, 28
#: Blocks that a row of the sketch is merged in.
BLOCKS = 64
#: Bytes of text hashed at a time, windows held before a slice ends, windows aimed at in a bucket.
SLICE, HELD, BUCKET = 1 << 19, 2_000_000, 1_000_000
#: Windows sorted at a time.
SORTED = 1 << 17
#: A null doc_id counts as larger than all others.
NO_ID = np.iinfo(np.int64).max
_U = np.uint64
#: Turns a window hash into another one, for the parts of a bucket.
_SPLIT = 0xD6E8FEB86659FD93


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, texts) of about SLICE bytes at a time; no others are held as Python objects."""
    texts, first, held = batch.column(column).cast(pa.binary()), 0, 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    for i, size in enumerate(sizes.tolist()):
        held += size
        if held >= SLICE:
            yield first, texts[first : i + 1].to_pylist()
            first, held = i + 1, 0
    if first < len(texts):
        yield first, texts[first:].to_pylist()


class Windows:
    """Windows of some texts: row and place, hash and anchor, and runs of one row and anchor."""

    def __init__(self, texts: list[bytes | None], width: int = WIDTH, group: int = GROUP):
        words, counts = split_all(texts)
        hashes = word_hashes(words)
        ends = np.cumsum(counts)
        each = np.maximum(counts - width + 1, 0)
        self.row = np.repeat(np.arange(len(texts)), each)
        self.place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        at = self.place + (ends - counts)[self.row]
        self.hash = windows(hashes, width)[at]
        self.anchor = sliding_min(windows(hashes, group), width - group + 1)[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (self.row[1:] != self.row[:-1]) | (self.anchor[1:] != self.anchor[:-1])
        self.starts = np.flatnonzero(new)


def cells(anchors: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each anchor in each row of the sketch."""
    return [(mixed(anchors + _U(0x632BE59BD9B4E019 * (r + 1) % (1 << 64))) >> _U(64 - bits)).astype(np.int64) for r in range(ROWS)]


def repeated_cells(docs: DataFrame, bits: int, width: int) -> np.ndarray:
    """Bitmaps (row, cell / 8) of the sketch's cells that two or more documents fill."""
    block = 1 << (bits - BLOCKS.bit_length() + 1)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        n = 0

        def flush() -> pa.RecordBatch:
            out = []
            for r, own in enumerate(held):
                cell, count = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.int64),) * 2
                edges = np.searchsorted(cell, np.arange(BLOCKS + 1) * block)
                for b, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
                    if y > x:
                        inside = (cell[x:y] - b * block).astype("<u4")
                        out.append((r * BLOCKS + b, inside[count[x:y] == 1].tobytes(), inside[count[x:y] > 1].tobytes()))
                own.clear()
            columns = list(zip(*out, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "once", "more"])

        for batch in batches:
            for _, texts in slices(batch):
                w = Windows(texts, width)
                # an anchor counts once for a document
                pair = np.unique(np.rec.fromarrays([w.row[w.starts], w.anchor[w.starts]]))
                for own, c in zip(held, cells(pair.f1, bits), strict=True):
                    own.append(c)
                n += len(pair)
                if n > HELD:
                    yield flush()
                    n = 0
        yield flush()

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(block, dtype=np.uint8)
        for column, add in (("once", 1), ("more", 2)):
            for raw in part[column]:
                at = np.frombuffer(raw, "<u4")
                count[at] = np.minimum(count[at] + add, 2)
        return pd.DataFrame({"block": part["block"].iloc[:1], "bitmap": [np.packbits(count > 1).tobytes()]})

    parts = docs.select("text").mapInArrow(lean(sketch), "block int, once binary, more binary")
    out = np.zeros((ROWS * BLOCKS, block // 8), dtype=np.uint8)
    for r in parts.groupBy("block").applyInPandas(merge, "block int, bitmap binary").collect():
        out[r["block"]] = np.frombuffer(r["bitmap"], np.uint8)
    return out.reshape(ROWS, -1)


def estimated(anchors: np.ndarray, bitmaps: np.ndarray, bits: int) -> np.ndarray:
    """Which anchors are estimated to be in two or more documents."""
    out = np.ones(len(anchors), dtype=bool)
    for row, cell in zip(bitmaps, cells(anchors, bits), strict=True):
        out &= (row[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return out


def _least(hashes: np.ndarray, anchors: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each entry the least document that has its window."""
    if not len(docs):
        return docs
    order = np.argsort(hashes, kind="stable")
    h, a = hashes[order], anchors[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (a[1:] != a[:-1])
    starts = np.flatnonzero(new)
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.repeat(np.minimum.reduceat(docs[order], starts), np.diff(np.append(starts, len(order))))
    return out


def _late(hashes: np.ndarray, run: np.ndarray, anchors: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which windows a smaller document has too; each has a hash and its run's number, runs have anchors and documents.

    Equal windows are in one part of the hashes, so a part is sorted by itself.
    """
    out = np.zeros(len(hashes), dtype=bool)
    parts = min(255, -(-len(hashes) // SORTED))
    own = np.empty(len(hashes), dtype=np.uint8)
    for x in range(0, len(hashes), SORTED):
        own[x : x + SORTED] = (hashes[x : x + SORTED] >> _U(32)) % _U(parts)
    for k in range(parts):
        at = np.flatnonzero(own == k)
        doc = docs[run[at]]
        out[at] = doc > _least(hashes[at], anchors[run[at]], doc)
    return out


def _stretches(keys: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(key, packed pairs of first place and number) from entries in any order."""
    if not len(keys):
        return
    order = np.lexsort((places, keys))
    keys, places = keys[order], places[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (places[1:] != places[:-1] + 1)
    starts = np.flatnonzero(new)
    pairs = np.stack([places[starts], np.diff(np.append(starts, len(keys)))], axis=1).astype("<i4")
    owner = keys[starts]
    cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    for x, y in zip(cuts, np.append(cuts[1:], len(owner)), strict=True):
        yield int(owner[x]), pairs[x:y].tobytes()


def _entries(held: list[tuple], own_ids: list[tuple[int, int]], buckets: int) -> Iterator[list[tuple]]:
    """Rows of a slice for ``repeats``, some BATCH_BYTES at a time; empties ``held`` and ``own_ids``.

    ``held`` has, for some texts each, the runs' documents (places in
    ``own_ids``), first places, lengths and anchors, and all windows' hashes.
    """
    if not held:
        return
    h = np.concatenate([x[-1] for x in held])
    doc, place, length, anchor = (np.concatenate(c) for c in list(zip(*held, strict=True))[:-1])
    ids = own_ids[:]
    held.clear()
    own_ids.clear()
    begin = np.cumsum(length) - length
    run = np.repeat(np.arange(len(length), dtype=np.int32), length)
    late = _late(h, run, anchor, np.array([i for i, _ in ids], dtype=np.int64)[doc])
    at = np.flatnonzero(late)
    rows = [(None, *ids[k], None, None, None, None, s) for k, s in _stretches(doc[run[at]], place[run[at]] + at - begin[run[at]])]
    # what is left of the runs, dealt out by the anchor
    at = np.flatnonzero(~late)
    del late
    new = np.ones(len(at), dtype=bool)
    new[1:] = (run[at[1:]] != run[at[:-1]]) | (at[1:] != at[:-1] + 1)
    starts = np.flatnonzero(new)
    length, first = np.diff(np.append(starts, len(at))), at[starts]
    del at, new, starts
    own = run[first]
    del run
    doc, place, anchor = doc[own], place[own] + first - begin[own], anchor[own]
    bucket = (mixed(anchor) % _U(buckets)).astype(np.int64)
    order = np.lexsort((doc, bucket))
    edge = np.ones(len(order), dtype=bool)
    edge[1:] = (bucket[order][1:] != bucket[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    cuts = np.flatnonzero(edge)
    size = sum(len(r[-1]) for r in rows)
    for x, y in zip(cuts, np.append(cuts[1:], len(order))[: len(cuts)], strict=True):
        runs = order[x:y]
        hashes = b"".join(h[first[r] : first[r] + length[r]].tobytes() for r in runs)
        rows.append((int(bucket[runs[0]]), *ids[doc[runs[0]]], place[runs].astype("<i4").tobytes(), length[runs].astype("<i4").tobytes(), anchor[runs].tobytes(), hashes, None))
        size += len(hashes) + 16 * len(runs)
        if size >= BATCH_BYTES:
            yield rows
            rows, size = [], 0
    yield rows


def _settled(part: pd.DataFrame) -> list[tuple]:
    """(doc_id, text_hash, stretches) of a bucket's windows that a smaller document has."""
    counts = np.array([len(x) // 4 for x in part["n"]])
    length = np.frombuffer(b"".join(part["n"]), "<i4").astype(np.int64)
    place = np.frombuffer(b"".join(part["place"]), "<i4").astype(np.int64)
    anchor = np.frombuffer(b"".join(part["anchor"]), "<u8")
    h = np.frombuffer(b"".join(part["hashes"]), "<u8")
    row = np.repeat(np.arange(len(part)), counts)
    run = np.repeat(np.arange(len(length), dtype=np.int32), length)
    at = np.flatnonzero(_late(h, run, anchor, part["doc_id"].to_numpy(dtype=np.int64)[row]))
    own = run[at]
    ids, marks = part["doc_id"].to_numpy(), part["text_hash"].to_numpy()
    return [(ids[k], marks[k], s) for k, s in _stretches(row[own], place[own] + at - (np.cumsum(length) - length)[own])]


def repeats(docs: DataFrame, bitmaps: np.ndarray, bits: int, buckets: int, width: int) -> DataFrame:
    """(doc_id, text_hash, stretches) of the windows that an earlier document has."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmaps)
    schema = "bucket int, doc_id long, text_hash long, place binary, n binary, anchor binary, hashes binary, stretches binary"
    types = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
    names = [x.split()[0] for x in schema.split(", ")]

    def record(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        own_ids: list[tuple[int, int]] = []
        n = 0
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NO_ID).to_pylist()
            text_hashes = batch.column("text_hash").to_pylist()
            for first, texts in slices(batch):
                w = Windows(texts, width)
                length = np.diff(np.append(w.starts, len(w.row)))
                good = estimated(w.anchor[w.starts], sent.value, bits)
                if good.any():
                    at = w.starts[good]
                    held.append((w.row[at] + len(own_ids), w.place[at], length[good], w.anchor[at], w.hash[np.repeat(good, length)]))
                    own_ids += zip(ids[first : first + len(texts)], text_hashes[first : first + len(texts)], strict=True)
                    n += len(held[-1][-1])
                if n > HELD:
                    yield from map(record, _entries(held, own_ids, buckets))
                    n = 0
        yield from map(record, _entries(held, own_ids, buckets))

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(_settled(part), columns=["doc_id", "text_hash", "stretches"])
        # a worker has many buckets, one after the other
        if part["hashes"].map(len).sum() >= BATCH_BYTES:
            trim()
        return out

    found = cut(docs.select("doc_id", "text", "text_hash").mapInArrow(lean(group), schema), "windows")
    open_ = dealt(found.where("bucket is not null").drop("stretches"))
    settled = open_.groupBy("bucket", "part").applyInPandas(settle, "doc_id long, text_hash long, stretches binary")
    return found.where("bucket is null").select("doc_id", "text_hash", "stretches").unionByName(settled)


def dealt(found: DataFrame) -> DataFrame:
    """Add part: buckets of many windows, as all windows around one common phrase are, are dealt out by window hash.

    All of a bucket or nothing is, so equal windows still meet.
    """
    size = found.groupBy("bucket").agg(F.sum(F.octet_length("hashes") / 8).alias("_n")).where(F.col("_n") > 2 * BUCKET)
    hot = cut(size.select("bucket", F.ceil(F.col("_n") / BUCKET).cast("int").alias("parts")), "hot")
    n = hot.count()
    whole = found.withColumn("part", F.lit(0))
    if not n:
        return whole
    names = ["bucket", "doc_id", "text_hash", "place", "n", "anchor", "hashes", "part"]
    types = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.int32()]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                length = np.frombuffer(r["n"], "<i4").astype(np.int64)
                start, anchor, h = np.frombuffer(r["place"], "<i4"), np.frombuffer(r["anchor"], "<u8"), np.frombuffer(r["hashes"], "<u8")
                place = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(len(h))
                own = (mixed(h ^ _U(_SPLIT)) % _U(r["parts"])).astype(np.int64)
                anchor = np.repeat(anchor, length)
                for k in np.unique(own):
                    at = np.flatnonzero(own == k)
                    rows.append((r["bucket"], r["doc_id"], r["text_hash"], place[at].astype("<i4").tobytes(), np.ones(len(at), "<i4").tobytes(), anchor[at].tobytes(), h[at].tobytes(), int(k)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    few = light(hot, n)
    divided = found.join(few, "bucket").mapInArrow(lean(split), "bucket int, doc_id long, text_hash long, place binary, n binary, anchor binary, hashes binary, part int")
    return whole.join(few, "bucket", "left_anti").select(*names).unionByName(divided)


def dedup(docs: DataFrame, width: int = WIDTH, most_bits: int = MOST_BITS) -> DataFrame:
    """Remove from every text of ``docs`` (doc_id, text) the words of repeated windows.

    A window counts as repeated if its words also start a window in a document
    with a smaller doc_id; windows are judged on the input. Returns doc_id,
    n_words, n_removed, spans (array of first word and number of words removed)
    and kept_text, the other words joined by one space. Null and empty texts have
    no words; a null doc_id is larger than all others; rows of one doc_id never
    repeat each other. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    narrow(docs.sparkSession)
    words = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6
    bits = min(most_bits, max(LEAST_BITS, int(words * CELLS_PER_WORD).bit_length()))
    bitmaps = repeated_cells(docs, bits, width)
    found = repeats(docs, bitmaps, bits, max(8, int(words // BUCKET)), width)
    by_doc = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_list("stretches").alias("stretches"))
    joined = docs.join(by_doc.hint("shuffle_hash"), (F.coalesce("doc_id", F.lit(int(NO_ID))) == F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, all_found = batch.column("doc_id"), batch.column("stretches")
            for first, texts in slices(batch):
                n, gone, spans, kept = [], [], [], []
                for i, text in enumerate(texts, first):
                    words_ = (text or b"").split()
                    marks: list[list[int]] = []
                    for x, many in sorted(map(tuple, np.frombuffer(b"".join(all_found[i].as_py() or []), "<i4").reshape(-1, 2).tolist())):
                        end = x + many - 1 + width
                        if marks and x <= marks[-1][1]:
                            marks[-1][1] = max(marks[-1][1], end)
                        else:
                            marks.append([x, end])
                    left, at = [], 0
                    for x, end in marks:
                        left += words_[at:x]
                        at = end
                    left += words_[at:]
                    n.append(len(words_))
                    gone.append(len(words_) - len(left))
                    spans.append([{"start": x, "length": end - x} for x, end in marks])
                    kept.append(b" ".join(left))
                yield pa.RecordBatch.from_arrays([ids[first : first + len(texts)], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return joined.select("doc_id", "text", "stretches").mapInArrow(lean(remove), "doc_id long, n_words long, n_removed long, spans array<struct<start:int,length:int>>, kept_text string")
