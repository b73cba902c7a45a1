"""Approximate nearest neighbours by an inverted multi-index.

Vectors are scaled to length 1, so that the nearest in distance is the nearest in
cosine, and cut in two halves; each half has its own centroids, whose number
grows with the table, and a pair of centroids is a cell. For a query, a heap
walks the pairs in the order of the summed distances of the halves until their
cells hold enough vectors; the distance at which it ends says which cells are
the query's. Vectors lie in blocks of one first centroid. Blocks of queries meet
those blocks that have a cell of one of theirs; in there only the vectors of a
query's own cells are ranked, in single precision, and the best are compared
exactly, in double precision, on the original vectors.

How far the walk goes: always to ``share`` of all vectors, if they have no
clusters; as soon as ``entries_least`` are held and the next cell is GAP times as
far as where they were, if they have.

Centroids are fitted on a bounded sample; every row is indexed. Equal vectors are
one entry that keeps the ``k + 1`` smallest ids, as no answer can need more of
them: copies of a common vector make no cell hot, and no answer changes.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean, light, narrow

#: Rows of the sample; least and most centroids of a half; vectors and queries in a block; blocks that a group of queries meets in one task.
SAMPLE, LEAST_CENTROIDS, MOST_CENTROIDS, BLOCK, QUERIES, SHARED = 20_000, 32, 1024, 4096, 2048, 8
#: Entries compared for a query: at least so many, and at most this share of all, unless the next cells are so many times as far.
ENTRIES, SHARE, GAP, STEP = 1_000, 0.4, 1.5, 1.02
#: Scores in single precision closer than this are compared again, summed in a fixed order.
NEAR = 1e-5
#: Distances of one pair that were taken in different batches differ by less than this.
ROUNDING = 1e-9
#: Rows whose distances to all centroids are held at a time.
ROWS = 1024


@dataclass
class Codebooks:
    halves: list[np.ndarray]
    dim: int

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distances of unit vectors' halves to the centroids."""
        cut_ = self.dim // 2
        parts = (x[:, :cut_], x[:, cut_:])
        return [np.maximum((p * p).sum(1)[:, None] - 2 * p @ c.T + (c * c).sum(1)[None], 0.0) for p, c in zip(parts, self.halves, strict=True)]

    def cells(self, x: np.ndarray) -> list[np.ndarray]:
        parts = [[d.argmin(1).astype(np.int32) for d in self.distances(x[i : i + ROWS])] for i in range(0, max(1, len(x)), ROWS)]
        return [np.concatenate(half) for half in zip(*parts, strict=True)]


def units(raw: bytes, dim: int, kind: str) -> np.ndarray:
    x = np.frombuffer(raw, dtype=kind).reshape(-1, dim).astype(np.float64)
    # scaled first: squares of very large or small components stay in range
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 15) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        size = (centres * centres).sum(1)[None]
        own = np.concatenate([(size - 2 * x[i : i + ROWS] @ centres.T).argmin(1) for i in range(0, len(x), ROWS)])
        centres = np.array([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
    return centres


def sampled(entries: DataFrame, n: int, sample: int) -> DataFrame:
    """The ``sample`` of ``n`` entries (raw) with the smallest hash.

    Hashes are even, so a bound lets little more than the sample through: else
    every task would send as many rows as the whole sample has.
    """
    hashed = entries.select("raw", F.xxhash64("raw").alias("_h"))
    share = (sample + 10 * sample**0.5 + 100) / max(n, 1)
    low = hashed.where(F.col("_h") <= int((share - 0.5) * 2.0**64)) if share < 1 else hashed
    return low.orderBy("_h").limit(sample).select("raw")


def fit(entries: DataFrame, n: int, dim: int, kind: str, centroids: int, sample: int = SAMPLE) -> Codebooks:
    """Centroids from the ``sample`` of ``n`` entries (raw) with the smallest hash."""
    rows = sampled(entries, n, sample).toArrow().column("raw").to_pylist()
    x = units(b"".join(rows), dim, kind) if rows else np.zeros((1, dim))
    return Codebooks([kmeans(x[:, : dim // 2], centroids), kmeans(x[:, dim // 2 :], centroids, 1)], dim)


def walk(near: list[np.ndarray], counts: np.ndarray, least: int, most: int) -> float:
    """The summed distance up to which cells are a query's: a heap goes through the pairs in order.

    ``counts`` are the entries of the cells by both halves. The heap holds the
    next pair of every first centroid; one that is taken out goes on to all its
    pairs no more than STEP times as far. The walk ends when it holds ``most``,
    or ``least`` and the next pair is GAP times as far.
    """
    (a, b), (one, two) = (np.argsort(d, kind="stable") for d in near), near
    first, second = one[a].tolist(), two[b].tolist()
    held = np.cumsum(counts[np.ix_(a, b)], axis=1).tolist()
    heap, n, out, enough = [(first[0] + second[0], 0, 0)], 0, 0.0, None
    while heap and n < most:
        d, i, j = heapq.heappop(heap)
        if enough is not None and d > GAP * max(enough, 1e-9):
            break
        if j == 0 and i + 1 < len(first):
            heapq.heappush(heap, (first[i + 1] + second[0], i + 1, 0))
        end = max(j + 1, bisect.bisect_right(second, d * STEP - first[i], j))
        if got := held[i][end - 1] - (held[i][j - 1] if j else 0):
            n, out = n + got, max(out, first[i] + second[end - 1])
            if enough is None and n >= least:
                enough = out
        if end < len(second):
            heapq.heappush(heap, (first[i] + second[end], i, end))
    return out


def _cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of one query and rows, every sum taken in the order of the components."""
    total = lambda v: np.cumsum(v, axis=-1)[..., -1]
    return total(x * q) / np.sqrt(total(q * q)) / np.sqrt(total(x * x))


def usable(rows: DataFrame, vector: str = "embedding", ident: str = "vec_id") -> tuple[DataFrame, str]:
    """(vec_id, n, raw) of the rows that take part, raw the components' bytes, and numpy's name of their type.

    Vectors that are null, empty, zero or hold null or non-finite components take
    no part, nor do null ids.
    """
    kind = "<f4" if rows.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"
    wide = "float" if kind == "<f4" else "double"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
            flat = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).astype(kind))
            row = np.repeat(np.arange(len(sizes)), sizes)
            bad = np.bincount(row[~np.isfinite(flat)], minlength=len(sizes)) > 0
            some = np.bincount(row[flat != 0], minlength=len(sizes)) > 0
            at = np.flatnonzero(~bad & some & ids.is_valid().to_numpy(zero_copy_only=False))
            starts, body, width = np.cumsum(sizes) - sizes, flat.tobytes(), flat.itemsize
            raw = [body[starts[k] * width : (starts[k] + sizes[k]) * width] for k in at]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(sizes[at].astype(np.int32)), pa.array(raw, pa.binary())], names=["vec_id", "n", "raw"])

    narrow(rows.sparkSession)
    return rows.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{wide}>").alias("v")).mapInArrow(lean(pack), "vec_id long, n int, raw binary"), kind


def search(rows: DataFrame, k: int = 5, every: int = 50, vector: str = "embedding", ident: str = "vec_id", entries_least: int = ENTRIES, share: float = SHARE, centroids: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """The k nearest found of every row whose id is divisible by ``every``, among all other rows.

    Returns query_id, rank, vec_id, score; the largest cosine first, ties to the
    smaller id; fewer rows where fewer vectors take part (see ``usable``; of the
    lengths the most usual one does, and of several vectors under one id the
    smallest by its bytes), and none for an empty table. Other columns are
    ignored.
    """
    spark = rows.sparkSession
    found, kind = usable(rows, vector, ident)
    found = cut(found, "vectors")
    sizes = found.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    dim = sizes["n"] if sizes else 1
    vectors = found.where(F.col("n") == dim).select("vec_id", "raw")
    if vectors.groupBy("vec_id").count().where("count > 1").take(1):
        vectors = cut(vectors.groupBy("vec_id").agg(F.min("raw").alias("raw")), "vectors")
    # the limit of the rank is taken before the shuffle too: a common vector sends few rows
    first = Window.partitionBy("raw").orderBy("vec_id")
    entries = vectors.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1).groupBy("raw").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = cut(entries, "entries")
    n = entries.count()
    centroids = centroids or min(MOST_CENTROIDS, max(LEAST_CENTROIDS, 1 << max(0, round(np.log2(max(n, 1) ** 0.5 / 2)))))
    books = fit(entries, n, dim, kind, centroids, sample)
    shape = tuple(len(h) for h in books.halves)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = books.cells(units(b"".join(batch.column(0).to_pylist()), dim, kind))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a), pa.array(b)], names=["raw", "ids", "a", "b"])

    index = cut(entries.mapInArrow(lean(assign), "raw binary, ids array<long>, a int, b int"), "index")
    counts = np.zeros(shape, dtype=np.int64)
    # at most centroids x centroids rows, which come as columns: a million Row objects would fill the driver
    filled = index.groupBy("a", "b").agg(F.count("*").alias("n")).toArrow()
    counts[filled["a"].to_numpy(), filled["b"].to_numpy()] = filled["n"].to_numpy()
    most = max(entries_least, int(share * n), k + 1)
    sent = spark.sparkContext.broadcast((books, counts))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, counts = sent.value
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                near = books.distances(units(b"".join(part.column(1).to_pylist()), dim, kind))
                # the last cell lies exactly at the walk's end, and compare takes its distance again, in another batch
                reach = [walk([d[i] for d in near], counts, max(entries_least, k + 1), most) + ROUNDING for i in range(part.num_rows)]
                # first centroids that have a cell within reach
                least = near[1].min(1)
                meets = [np.flatnonzero(near[0][i] + least[i] <= reach[i]).astype(np.int32) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(reach, pa.float64()), pa.array(meets, pa.list_(pa.int32()))], names=["query_id", "qraw", "reach", "meets"])

    asked = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("raw").alias("qraw"))
    probes = cut(asked.mapInArrow(lean(probe), "query_id long, qraw binary, reach double, meets array<int>"), "probes")
    groups = max(1, -(-probes.count() // QUERIES))
    group = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group")
    asking = probes.groupBy(group).agg(F.collect_list(F.struct("query_id", "qraw", "reach")).alias("queries"))
    sized = spark.createDataFrame([(i, int(-(-c // BLOCK))) for i, c in enumerate(counts.sum(1)) if c], "a int, blocks int")
    block = F.pmod(F.xxhash64("raw"), F.col("blocks")).cast("int").alias("block")
    blocks = index.join(F.broadcast(sized), "a").groupBy("a", block).agg(F.collect_list(F.struct("raw", "ids", "b")).alias("entries"))
    meets = probes.select(group, F.explode("meets").alias("a")).distinct()
    # a group's queries go to several tasks, each with some of the blocks that it meets
    shares = max(1, -(-sum(int(-(-c // BLOCK)) for c in counts.sum(1)) // SHARED))
    met = blocks.join(light(meets, groups * shape[0]), "a").withColumn("part", F.pmod(F.xxhash64("a", "block"), F.lit(shares)).cast("int"))
    # merged, never broadcast: before the copies for the parts a group's queries look small, and all copies would go through the driver
    copies = asking.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    paired = met.join(copies.hint("merge"), ["group", "part"]).select("a", "entries", "queries")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value[0]
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            for r in range(batch.num_rows):
                held, asked = batch.column(1)[r].values, batch.column(2)[r].values
                raws, qraws = (b"".join(c.to_pylist()) for c in (held.field("raw"), asked.field("qraw")))
                x, q = (np.frombuffer(c, kind).reshape(-1, dim) for c in (raws, qraws))
                ux, uq = units(raws, dim, kind).astype(np.float32), units(qraws, dim, kind)
                near = books.distances(uq)
                reach = asked.field("reach").to_numpy()[:, None]
                inside = near[0][:, [batch.column(0)[r].as_py()]] + near[1][:, held.field("b").to_numpy()] <= reach
                rough = np.where(inside, uq.astype(np.float32) @ ux.T, np.float32(-2))
                keep = min(k + 1, len(x))
                floor = np.maximum(np.partition(rough, len(x) - keep, axis=1)[:, len(x) - keep] - NEAR, -1.5)
                ids, queries = held.field("ids"), asked.field("query_id").to_pylist()
                for i, query in enumerate(queries):
                    at = np.flatnonzero(rough[i] >= floor[i])
                    scores = _cosines(q[i].astype(np.float64), x[at].astype(np.float64))
                    scored = [(-s, v) for s, e in zip(scores.tolist(), at.tolist(), strict=True) for v in ids[e].as_py() if v != query]
                    out += [(query, v, -s) for s, v in heapq.nsmallest(k, scored)]
            columns = [*zip(*out, strict=True)] or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    pairs = paired.mapInArrow(lean(compare), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
