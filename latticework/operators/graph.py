"""Sparse relations (i, j, w_raw): closure, components, shells and shortest paths."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.storage import cut

#: Edges that may be sent to every task as one sparse matrix.
MOST_EDGES = 20_000_000


def both_ways(pairs: DataFrame) -> DataFrame:
    """Edges in both directions, each once, from pairs (i, j)."""
    return pairs.select(F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("e")).select("e.i", "e.j").where("i <> j").distinct()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ord, root, component): least member and number, in the order of least members.

    Large and small stars in turn until nothing changes: a few rounds, each of
    as many rows as there are nodes, whatever the diameter.
    """
    from latticework.model import ranked

    links, before = cut(edges.select(F.greatest("i", "j").alias("u"), F.least("i", "j").alias("v")).where("u <> v").distinct(), "links"), None
    while True:
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.withColumnRenamed("m", "v"))
        links = cut(stars.distinct(), "links")
    rooted = nodes.select("ord").join(links.select(F.col("u").alias("ord"), F.col("v").alias("root")), "ord", "left").withColumn("root", F.coalesce("root", "ord"))
    numbers = ranked(rooted.select("root").distinct(), "root").select("root", (F.col("ord") + 1).alias("component"))
    return rooted.join(numbers, "root").select("ord", "root", "component")


def shells(edges: DataFrame, most: int) -> DataFrame:
    """(i, j, order): pairs whose shortest path has exactly ``order`` steps, up to ``most``."""
    step = edges.select("i", "j").distinct()
    reached = front = cut(step.withColumn("order", F.lit(1)), "shell")
    for order in range(2, most + 1):
        further = front.select("i", F.col("j").alias("via")).join(step.select(F.col("i").alias("via"), "j"), "via").where("i <> j").select("i", "j").distinct()
        front = cut(further.join(reached.select("i", "j"), ["i", "j"], "left_anti").withColumn("order", F.lit(order)), "shell")
        if not front.take(1):
            break
        reached = reached.unionByName(front)
    return reached


def csr(edges: DataFrame, n: int, value: str = "w", most: int = MOST_EDGES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, columns, values) on the driver, after the count of edges is checked."""
    if (m := edges.count()) > most:
        raise ValueError(f"{m} edges; a task can be sent {most}")
    table = edges.select("i", "j", F.col(value).alias("v")).toPandas().sort_values(["i", "j"], kind="stable")
    starts = np.searchsorted(table["i"].to_numpy(), np.arange(n + 1))
    return starts, table["j"].to_numpy(dtype=np.int64), table["v"].to_numpy(dtype=float)


def dot(matrix: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Sparse matrix times vector or columns."""
    starts, columns, values = matrix
    wide = values[:, None] * x[columns] if x.ndim > 1 else values * x[columns]
    sums = np.concatenate([np.zeros((1, *wide.shape[1:])), np.cumsum(wide, axis=0)])
    return sums[starts[1:]] - sums[starts[:-1]]


def shortest(edges: DataFrame, n: int, sources: DataFrame, value: str = "length", most: float = float("inf")) -> DataFrame:
    """(source, target, distance) by Dijkstra from every row of ``sources`` (ord), one source at a time in a task.

    The edges go to every task, so their number is checked first.
    """
    sent = sources.sparkSession.sparkContext.broadcast(csr(edges, n, value))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, columns, lengths = sent.value
        for part in parts:
            for source in part["ord"]:
                best, heap = {int(source): 0.0}, [(0.0, int(source))]
                done: dict[int, float] = {}
                while heap:
                    d, u = heapq.heappop(heap)
                    if u in done:
                        continue
                    done[u] = d
                    for v, w in zip(columns[starts[u] : starts[u + 1]].tolist(), lengths[starts[u] : starts[u + 1]].tolist(), strict=True):
                        if d + w <= most and d + w < best.get(v, float("inf")):
                            best[v] = d + w
                            heapq.heappush(heap, (d + w, v))
                yield pd.DataFrame({"source": int(source), "target": [*done], "distance": [*done.values()]})

    return sources.select("ord").mapInPandas(run, "source long, target long, distance double")
