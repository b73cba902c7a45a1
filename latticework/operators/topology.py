"""Adjacency, geometry, distances and spatial weights."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.model import Dataset
from latticework.storage import cut

from .graph import both_ways, components, shortest
from .reach import Pairs, Sums, meet, tiled

STYLES = ("W", "B", "none")
#: Rows of a cell above which the nearest join starts from smaller cells.
CROWD = 512


def adjacency(x: Dataset, connectivity: int = 6, region_edges: DataFrame | None = None) -> DataFrame:
    """(i, j) both ways: mesh edges, voxel neighbours, both inside the components of a composite, or given region pairs."""
    if x.kind == "region":
        if region_edges is None:
            raise ValueError("regions have the adjacency they are given")
        return both_ways(region_edges)
    found = []
    if x.faces is not None:
        found.append(both_ways(x.faces.select(F.explode(F.array(*[F.struct(F.col(a).alias("i"), F.col(b).alias("j")) for a, b in (("v1", "v2"), ("v2", "v3"), ("v1", "v3"))])).alias("e")).select("e.i", "e.j")))
    if x.kind in ("volume", "composite"):
        found.append(voxel_pairs(x.elements, connectivity))
    if not found:
        raise ValueError(f"a {x.kind} base has no topology")
    return reduce(DataFrame.unionByName, found)


def offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """Half of the 6, 18 or 26 lattice neighbours: those after the origin in order."""
    steps = {6: 1, 18: 2, 26: 3}[connectivity]
    return [o for o in itertools.product((-1, 0, 1), repeat=3) if o > (0, 0, 0) and sum(map(abs, o)) <= steps]


def voxel_pairs(elements: DataFrame, connectivity: int = 6) -> DataFrame:
    """Lattice neighbours by an equi-join on shifted coordinates, inside a component."""
    cells = elements.where("i is not null").select("ord", "i", "j", "k", F.coalesce("component_id", F.lit("")).alias("c"))
    shift = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, "abc", strict=True)]) for o in offsets(connectivity)])
    moved = cells.select(F.col("ord").alias("from"), "c", "i", "j", "k", F.explode(shift).alias("o")).select("from", "c", (F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j"), (F.col("k") + F.col("o.c")).alias("k"))
    return both_ways(moved.join(cells, ["c", "i", "j", "k"]).select(F.col("from").alias("i"), F.col("ord").alias("j")))


def connected(x: Dataset, edges: DataFrame | None = None) -> DataFrame:
    return components(edges if edges is not None else adjacency(x), x.elements)


def triangles(x: Dataset, coordinates: str = "active") -> DataFrame:
    """Faces with their corners' coordinates (ax .. cz) and area."""
    at = x.coordinates.get(coordinates, x.elements).select("ord", "x", "y", "z")
    found = x.faces
    for v, p in zip(("v1", "v2", "v3"), "abc", strict=True):
        found = found.join(at.select(F.col("ord").alias(v), *[F.coalesce(F.col(c), F.lit(0.0)).alias(p + c) for c in "xyz"]), v)
    u, v = ([F.col(p + c) - F.col("a" + c) for c in "xyz"] for p in "bc")
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return found.withColumn("area", 0.5 * F.sqrt(sum((c * c for c in cross[1:]), cross[0] * cross[0])))


def vertex_area(x: Dataset, coordinates: str = "active") -> DataFrame:
    """(ord, area): a third of every incident triangle."""
    if coordinates != "active" and x.roles.get(coordinates) != "anatomical":
        raise ValueError("only anatomical coordinates are metric")
    thirds = triangles(x, coordinates).select(F.explode(F.array("v1", "v2", "v3")).alias("ord"), (F.col("area") / 3).alias("area"))
    return x.elements.select("ord").join(thirds.groupBy("ord").agg(F.sum("area").alias("area")), "ord", "left").fillna(0.0, ["area"])


def cotangent(x: Dataset, coordinates: str = "active") -> DataFrame:
    """(i, j, w_raw) both ways: half the cotangents of the angles opposite an edge, for Laplacians of a surface."""
    t = triangles(x, coordinates)
    each = None
    for o, (p, q), (vp, vq) in (("a", "bc", ("v2", "v3")), ("b", "ca", ("v3", "v1")), ("c", "ab", ("v1", "v2"))):
        u, v = ([F.col(e + c) - F.col(o + c) for c in "xyz"] for e in (p, q))
        dot = u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
        row = t.select(F.col(vp).alias("i"), F.col(vq).alias("j"), (0.5 * F.try_divide(dot, 2 * F.col("area"))).alias("w_raw"))
        each = row if each is None else each.unionByName(row)
    both = each.unionByName(each.select(F.col("j").alias("i"), F.col("i").alias("j"), "w_raw"))
    return both.groupBy("i", "j").agg(F.sum("w_raw").alias("w_raw"))


def voxel_volume(x: Dataset) -> float:
    import numpy as np

    return float(abs(np.linalg.det(np.asarray(x.affine)[:3, :3])))


def support_size(x: Dataset) -> DataFrame:
    """(ord, support): barycentric area, voxel volume, given region support, or null for points."""
    if x.faces is not None:
        areas = vertex_area(x).select("ord", F.col("area").alias("support"))
        return areas if x.kind == "surface" else x.elements.select("ord", F.col("support").alias("own")).join(areas, "ord").select("ord", F.coalesce("own", "support").alias("support"))
    if x.kind == "volume":
        return x.elements.select("ord", F.lit(voxel_volume(x)).alias("support"))
    return x.elements.select("ord", "support")


def _squared(dims: str, a: str, b: str) -> Column:
    return sum(((F.col(a + c) - F.col(b + c)) ** 2 for c in dims[1:]), (F.col(a + dims[0]) - F.col(b + dims[0])) ** 2)


def within(left: DataFrame, right: DataFrame, radius: float, dims: str = "xyz") -> DataFrame:
    """(i, j, distance) for all pairs no further than ``radius``: a range join on grid cells.

    Every left row goes to the cells around its own, and meets only rows of those:
    an equi-join, never a product of the sides.
    """
    if radius <= 0:
        raise ValueError("the radius must be positive")
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    around = F.array(*[F.array(*map(F.lit, o)) for o in itertools.product((-1, 0, 1), repeat=len(dims))])
    a = left.select(F.col("ord").alias("i"), *[F.col(c).alias("a" + c) for c in dims], F.explode(around).alias("o"))
    a = a.select("i", *["a" + c for c in dims], *[(cell("a" + c) + F.col("o")[n]).alias("g" + c) for n, c in enumerate(dims)])
    b = right.select(F.col("ord").alias("j"), *[F.col(c).alias("b" + c) for c in dims], *[cell(c).alias("g" + c) for c in dims])
    met = a.join(b, ["g" + c for c in dims]).withColumn("distance", F.sqrt(_squared(dims, "a", "b")))
    return met.where(F.col("distance") <= radius).select("i", "j", "distance")


def weights_within(at: DataFrame, radius: float, weigh: Callable, dims: str = "xyz", style: str = "W", apart: bool = False) -> DataFrame:
    """(i, j, w) of the pairs no further than ``radius``, w from ``weigh`` of their distances: as it is, or its share in the row's sum.

    The sums are taken where the pairs are met, and the pairs are met again with
    them: no pair is shuffled. With ``apart`` pairs at distance 0 are left out.
    """
    if style not in ("W", "none"):
        raise ValueError(f"unknown style {style!r}")
    tiles, own, left = tiled(at, dims), at.select("ord", *dims), None

    def total(ords: np.ndarray, sums: np.ndarray):  # noqa: ANN202
        yield pa.RecordBatch.from_arrays([pa.array(ords), pa.array(sums[:, 0])], names=["ord", "total"])

    if style == "W":
        weighed = lambda d: np.where(d > 0, weigh(np.where(d > 0, d, 1.0)), 0.0) if apart else weigh(d)
        left = cut(meet(tiles, None, own.select("*", F.lit(1.0).alias("_s"), F.lit(1.0).alias("_one")), radius, lambda: Sums(weighed, 1, lambda i, j: i != j, total), "ord long, total double"), "totals")
    keep = (lambda i, j, d: (i != j) & (d > 0)) if apart else (lambda i, j, _: i != j)
    return meet(tiles, left, own, radius, lambda: Pairs(["i", "j", "w"], weigh, keep, style == "W"), "i long, j long, w double")


def _start(right: DataFrame, radius: float, dims: str, crowd: int) -> float:
    """``radius`` halved until no cell has more than ``crowd`` rows, or eight halvings in a row part none of the fullest."""
    kept, before, idle = radius, None, 0
    while idle < 8:
        top = right.groupBy(*[F.floor(F.col(c) / radius).cast("long").alias("g" + c) for c in dims]).count().agg(F.max("count")).first()[0] or 0
        if before is None or top < before:
            kept, before, idle = radius, top, 0
        else:
            idle += 1
        if top <= crowd:
            break
        radius /= 2
    return kept


def nearest(left: DataFrame, right: DataFrame, k: int, dims: str = "xyz", same: bool = True) -> DataFrame:
    """(i, j, distance, rank) of the k nearest right rows of every left row; ties to the smaller ordinal.

    Exact: a row is settled once k are found within the radius of a grid join;
    the radius doubles for those that are left, and ends with the whole extent.
    It starts where no cell is crowded, so rows of a dense cluster are settled in
    small cells before the others look further.
    """
    stats = right.agg(F.count("*"), *[f(c) for c in dims for f in (F.min, F.max)]).first()
    both = left.agg(*[f(c) for c in dims for f in (F.min, F.max)]).first()
    n = stats[0]
    spans = [max(stats[2 + 2 * d], both[1 + 2 * d]) - min(stats[1 + 2 * d], both[2 * d]) for d in range(len(dims))] if n else []
    extent = sum(s * s for s in spans) ** 0.5
    wide = [s for s in spans if s > 0]
    side = 1.0
    for s in wide:
        side *= s
    radius = (side * (k + 1) * 2 / max(n, 1)) ** (1 / max(1, len(wide))) if wide else 1.0
    want = min(k, n - 1 if same else n)
    radius = _start(right, radius, dims, max(CROWD, 16 * k)) if want > 0 else radius
    open_, out = left.select("ord", *dims), []
    order = Window.partitionBy("i").orderBy("distance", "j")
    while want > 0:
        found = within(open_, right, radius, dims)
        found = found.where("i <> j") if same else found
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        last = radius > extent
        if not last:
            top = top.withColumn("_n", F.count("*").over(Window.partitionBy("i"))).where(F.col("_n") >= want).drop("_n")
        top = cut(top, "nearest")
        out.append(top)
        if last:
            break
        open_ = cut(open_.join(top.select(F.col("i").alias("ord")).distinct(), "ord", "left_anti"), "open")
        if not open_.take(1):
            break
        radius = min(radius * 2, extent * 1.000001 + 1e-300) if radius * 2 < extent else extent * 1.01 + 1e-300
    empty = left.sparkSession.createDataFrame([], "i long, j long, distance double, rank int")
    return reduce(DataFrame.unionByName, out, empty)


def distance(x: Dataset, sources: DataFrame, targets: DataFrame | None = None, method: str = "euclidean", most: float = float("inf"), connectivity: int = 6, pairs: int = 1_000_000) -> DataFrame:
    """(source, target, distance) for given ordinals: euclidean, edge_geodesic or hops; nothing beyond ``most``.

    Euclidean distances of all pairs are bounded by ``pairs``; with a finite
    ``most`` they are a range join without that bound.
    """
    targets = targets if targets is not None else x.elements.select("ord")
    if method == "euclidean":
        a, b = x.elements.join(sources, "ord", "left_semi"), x.elements.join(targets, "ord", "left_semi")
        dims = "xyz" if x.elements.where("z is not null").take(1) else "xy"
        if most < float("inf"):
            return within(a, b, most, dims).select(F.col("i").alias("source"), F.col("j").alias("target"), "distance")
        if (n := a.count() * b.count()) > pairs:
            raise ValueError(f"{n} pairs; the limit is {pairs}")
        met = a.select(F.col("ord").alias("source"), *[F.col(c).alias("a" + c) for c in dims]).join(F.broadcast(b.select(F.col("ord").alias("target"), *[F.col(c).alias("b" + c) for c in dims])), F.lit(True))
        return met.select("source", "target", F.sqrt(_squared(dims, "a", "b")).alias("distance"))
    edges = adjacency(x, connectivity)
    edges = lengths(x, edges) if method == "edge_geodesic" else edges.withColumn("length", F.lit(1.0))
    found = shortest(edges, x.elements.count(), sources, "length", most)
    return found.join(targets.select(F.col("ord").alias("target")), "target", "left_semi").select("source", "target", "distance")


def lengths(x: Dataset, edges: DataFrame) -> DataFrame:
    """Edges with the distance of their ends."""
    at = x.elements.select("ord", "x", "y", F.coalesce("z", F.lit(0.0)).alias("z"))
    for end, p in (("i", "a"), ("j", "b")):
        edges = edges.join(at.select(F.col("ord").alias(end), *[F.col(c).alias(p + c) for c in "xyz"]), end)
    return edges.select("i", "j", F.sqrt(_squared("xyz", "a", "b")).alias("length"))


def styled(edges: DataFrame, style: str = "W") -> DataFrame:
    """Add w to (i, j, w_raw): row shares, ones, or as they are."""
    if style not in STYLES:
        raise ValueError(f"unknown style {style!r}")
    if style == "W":
        return edges.withColumn("w", F.coalesce(F.try_divide("w_raw", F.sum("w_raw").over(Window.partitionBy("i"))), F.lit(0.0)))
    return edges.withColumn("w", F.lit(1.0) if style == "B" else F.col("w_raw"))


def symmetric(edges: DataFrame, rule: str = "union") -> DataFrame:
    """Keep an edge if either (union) or each direction (mutual) has it; directed leaves it."""
    if rule == "directed":
        return edges
    both = edges.select("i", "j", "distance", F.lit(1).alias("n")).unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "distance", F.lit(1).alias("n")))
    met = both.groupBy("i", "j").agg(F.min("distance").alias("distance"), F.count("*").alias("n"))
    return (met.where("n = 2") if rule == "mutual" else met).drop("n")


def weights(x: Dataset, method: str = "contiguity", style: str = "W", connectivity: int = 6, k: int | None = None, threshold: float | None = None, bandwidth: float | None = None, power: float = 1.0, symmetry: str = "union", region_edges: DataFrame | None = None) -> DataFrame:
    """(i, j, w_raw, w): contiguity, knn, distance_band, inverse_distance or gaussian."""
    if method == "contiguity":
        raw = adjacency(x, connectivity, region_edges).withColumn("w_raw", F.lit(1.0))
    else:
        dims = "xyz" if x.elements.where("z is not null").take(1) else "xy"
        at = x.elements.where("included").select("ord", *dims)
        near = symmetric(nearest(at, at, k, dims).drop("rank"), symmetry) if method == "knn" or threshold is None else within(at, at, threshold, dims).where("i <> j")
        if method == "inverse_distance":
            if near.where("distance = 0").take(1):
                raise ValueError("coincident elements have no inverse distance")
            raw = near.withColumn("w_raw", F.pow("distance", F.lit(-power)))
        elif method == "gaussian":
            raw = near.withColumn("w_raw", F.exp(-0.5 * F.pow(F.col("distance") / bandwidth, F.lit(2.0))))
        elif method in ("knn", "distance_band", "radius"):
            raw = near.withColumn("w_raw", F.lit(1.0))
        else:
            raise ValueError(f"unknown method {method!r}")
        raw = raw.select("i", "j", "w_raw")
    return styled(raw, style)


def neighbours(x: Dataset, method: str = "contiguity", **more) -> DataFrame:  # noqa: ANN003
    """Binary weights."""
    return weights(x, method, "B", **more)


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """(i, neighbours, weights) as sorted arrays: a list form for other tools."""
    got = edges.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "w"))).alias("e"))
    return got.select("i", F.col("e.j").alias("neighbours"), F.col("e.w").alias("weights"))


def partition(x: Dataset, labels: DataFrame, background: str | None = None, unlabelled: str = "exclude") -> DataFrame:
    """(ord, region_id): a crisp membership; background and missing labels are left out, or missing ones are an error."""
    own = x.elements.select("ord").join(labels.select("ord", F.col("label").cast("string").alias("region_id")), "ord", "left")
    if unlabelled == "error" and own.where("region_id is null").take(1):
        raise ValueError("elements without a label")
    return own.where(F.col("region_id").isNotNull() & (F.col("region_id") != background if background is not None else F.lit(True)))


def boundary(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(i, j, region_i, region_j) of the edges i < j between regions."""
    met = edges.where("i < j").select("i", "j")
    for end in "ij":
        met = met.join(membership.select(F.col("ord").alias(end), F.col("region_id").alias(f"region_{end}")), end)
    return met.where("region_i <> region_j").select("i", "j", "region_i", "region_j")


def region_adjacency(edges: DataFrame, membership: DataFrame, weight: str = "binary") -> DataFrame:
    """(region_a, region_b, w_raw) for a < b: 1, or the number of crossing edges."""
    pairs = boundary(edges, membership).groupBy(F.least("region_i", "region_j").alias("region_a"), F.greatest("region_i", "region_j").alias("region_b"))
    return pairs.agg((F.count("*").cast("double") if weight == "edge_count" else F.lit(1.0)).alias("w_raw"))


def quality_report(x: Dataset, edges: DataFrame | None = None, tolerance: float = 1e-8) -> DataFrame:
    """(check, status, n): constant layers, missing and non-finite values, isolates, components, folds; the worst decides."""
    spark, rows = x.spark, []
    per_layer = x.values.groupBy("layer_ord").agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.count("value").alias("n"), F.count_if(F.isnan("value") | (F.abs("value") == float("inf"))).alias("bad"))
    n = x.elements.count()
    constant, bad, missing = per_layer.agg(F.count_if(F.col("hi") - F.col("lo") <= tolerance), F.sum("bad"), F.sum(F.lit(n) - F.col("n"))).first()
    rows += [("constant_layers", constant or 0), ("nonfinite_values", bad or 0), ("missing_values", missing or 0)]
    rows.append(("unknown_semantics", x.measures.where("support_behavior = 'unknown'").count()))
    if edges is not None:
        rows.append(("isolates", x.elements.join(edges.select(F.col("i").alias("ord")).distinct(), "ord", "left_anti").count()))
        rows.append(("extra_components", components(edges, x.elements).agg(F.max("component")).first()[0] - 1))
    chart = next((k for k, v in x.roles.items() if v == "chart" and k in x.coordinates), None)
    if x.faces is not None and chart:
        rows.append(("chart_folds", folds(x, chart)))
    found = spark.createDataFrame([(k, "pass" if not v else "warning", int(v)) for k, v in rows], "check string, status string, n long")
    worst = found.agg(F.max("status").alias("status")).select(F.lit("overall").alias("check"), "status", F.lit(None).cast("long").alias("n"))
    return found.unionByName(worst)


def folds(x: Dataset, chart: str) -> int:
    """Triangles of a chart that turn the other way than most."""
    at, found = x.coordinates[chart].select("ord", "x", "y"), x.faces
    for v, p in zip(("v1", "v2", "v3"), "abc", strict=True):
        found = found.join(at.select(F.col("ord").alias(v), F.col("x").alias(p + "x"), F.col("y").alias(p + "y")), v)
    turn = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))
    row = found.agg(F.count_if(turn > 0), F.count_if(turn <= 0)).first()
    return min(row)
