"""Change of support: maps between bases, aggregation under a measure's meaning, and their diagnostics.

A support map is a sparse operator (target_ord, source_ord, weight) with the
support of each source. Everything is a join of values with the map and one
grouped aggregate for all layers at once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.model import Dataset, table_hash
from latticework.storage import cut

from .topology import nearest, support_size, within

TYPES = ("crisp", "probabilistic", "overlapping")


@dataclass(frozen=True)
class SupportMap:
    """``weights`` (target_ord, source_ord, weight and perhaps weight_var), ``support`` (source_ord, support)."""

    weights: DataFrame
    support: DataFrame
    kind: str = "crisp"
    coverage: str = "complete"

    def target_support(self) -> DataFrame:
        return self.weights.join(self.support, "source_ord").groupBy("target_ord").agg(F.sum(F.col("weight") * F.col("support")).alias("support"))


def violations(m: SupportMap, tolerance: float = 1e-10) -> DataFrame:
    """(rule, source_ord): entries that break the contract of the map's type and coverage."""
    sums = m.weights.groupBy("source_ord").agg(F.sum("weight").alias("s"), F.count_if(F.col("weight") != 0).alias("n"), F.min("weight").alias("low"), F.max("weight").alias("high"))
    rule = lambda name, cond: sums.where(cond).select(F.lit(name).alias("rule"), "source_ord")
    out = rule("negative", F.col("low") < 0)
    if m.kind == "crisp":
        out = out.unionByName(rule("crisp", (F.col("n") > 1) | ((F.abs(F.col("high") - 1) > tolerance) & (F.col("n") == 1))))
    if m.kind == "probabilistic":
        out = out.unionByName(rule("probabilistic", F.col("s") > 1 + tolerance))
    if m.coverage == "complete" and m.kind != "overlapping":
        out = out.unionByName(rule("complete", F.abs(F.col("s") - 1) > tolerance))
        out = out.unionByName(m.support.join(m.weights.select("source_ord"), "source_ord", "left_anti").select(F.lit("unmapped").alias("rule"), "source_ord"))
    return out


def support_map(weights: DataFrame, support: DataFrame, kind: str = "crisp", coverage: str = "complete", check: bool = True) -> SupportMap:
    if kind not in TYPES:
        raise ValueError(f"unknown type of map {kind!r}")
    m = SupportMap(weights, support, kind, coverage)
    if check and (bad := violations(m).take(3)):
        raise ValueError(f"not a {coverage} {kind} map: {bad}")
    return m


def map_hash(m: SupportMap) -> tuple[int, int, int]:
    return table_hash(m.weights)


def from_partition(membership: DataFrame, targets: DataFrame, support: DataFrame) -> SupportMap:
    """A partition (ord, region_id) to regions (ord, region_id) as a crisp map."""
    weights = membership.select(F.col("ord").alias("source_ord"), "region_id").join(targets.select(F.col("ord").alias("target_ord"), "region_id"), "region_id").select("target_ord", "source_ord", F.lit(1.0).alias("weight"))
    missing = support.join(weights, "source_ord", "left_anti").take(1)
    return SupportMap(weights, support, "crisp", "partial" if missing else "complete")


def atlas_map(x: Dataset, labels: DataFrame, exclude: tuple = (), support: DataFrame | None = None) -> tuple[SupportMap, DataFrame]:
    """Labels (ord, label) as a crisp map, and the regions (ord, region_id) in the order of their names."""
    from latticework.model import ranked

    own = labels.where(F.col("label").isNotNull() & ~F.col("label").cast("string").isin(list(map(str, exclude)))).select("ord", F.col("label").cast("string").alias("region_id"))
    targets = ranked(own.select("region_id").distinct(), "region_id").select("ord", "region_id")
    support = support if support is not None else support_size(x).select(F.col("ord").alias("source_ord"), "support")
    return from_partition(own, targets, support), targets


def probabilistic_map(probabilities: DataFrame, support: DataFrame, coverage: str = "auto", tolerance: float = 1e-10) -> SupportMap:
    """Probabilities (source_ord, target_ord, weight) as a map; coverage is found from the sums."""
    weights = probabilities.where("weight <> 0").select("target_ord", "source_ord", "weight")
    if coverage == "auto":
        sums = support.join(weights, "source_ord", "left").groupBy("source_ord").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("s"))
        coverage = "partial" if sums.where(F.abs(F.col("s") - 1) > tolerance).take(1) else "complete"
    return support_map(weights, support, "probabilistic", coverage)


def allocated(m: SupportMap, allocation: str = "error", unmapped: str = "error", tolerance: float = 1e-10) -> DataFrame:
    """Weights whose sums over targets are 1 for every source: what a conserved total is shared by."""
    if unmapped == "error" and m.support.join(m.weights.where("weight <> 0"), "source_ord", "left_anti").take(1):
        raise ValueError("sources without a target; drop them explicitly")
    sums = m.weights.groupBy("source_ord").agg(F.sum("weight").alias("s"))
    if allocation != "normalize":
        if sums.where((F.col("s") > 0) & (F.abs(F.col("s") - 1) > tolerance)).take(1):
            raise ValueError("weights do not conserve totals; normalise explicitly")
        return m.weights
    return m.weights.join(sums, "source_ord").withColumn("weight", F.col("weight") / F.col("s")).drop("s")


def aggregate(values: DataFrame, m: SupportMap, behaviour: str | Column, allocation: str = "error", unmapped: str = "error", keys: tuple[str, ...] = ("layer_ord",)) -> DataFrame:
    """Values (ord, keys, value) on the map's targets: (target_ord, keys, value).

    intensive: support-weighted mean; extensive and count: conserved sum;
    categorical: the category with most support, ties to the smallest. Targets
    without support give null; non-finite values are refused.
    """
    if behaviour == "unknown":
        raise ValueError("a layer of unknown meaning needs an explicit rule")
    if values.where(F.isnan("value") | (F.abs("value") == float("inf")) | F.col("value").isNull()).take(1):
        raise ValueError("non-finite values cannot be aggregated")
    weights = allocated(m, allocation, unmapped) if behaviour in ("extensive", "count") else m.weights
    met = values.withColumnRenamed("ord", "source_ord").join(weights, "source_ord")
    group = ["target_ord", *keys]
    if behaviour in ("extensive", "count"):
        return met.groupBy(*group).agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
    met = met.join(m.support, "source_ord").withColumn("ps", F.col("weight") * F.col("support"))
    if behaviour == "intensive":
        return met.groupBy(*group).agg(F.try_divide(F.sum(F.col("ps") * F.col("value")), F.sum("ps")).alias("value"))
    scores = met.groupBy(*group, "value").agg(F.sum("ps").alias("score"))
    # one pass: the largest score, then the smallest category
    return scores.groupBy(*group).agg(F.max_by("value", F.struct("score", (-F.col("value")).alias("v"))).alias("value"))


def aggregate_to(x: Dataset, targets: Dataset, m: SupportMap, allocation: str = "error", unmapped: str = "error", unknown: str = "error") -> Dataset:
    """All layers of ``x`` on the elements of ``targets``, each by its measure."""
    known = x.with_measures()
    rule = F.when(F.col("support_behavior") == "unknown", unknown).otherwise(F.col("support_behavior"))
    if unknown == "error" and x.measures.where("support_behavior = 'unknown'").take(1):
        raise ValueError("layers of unknown meaning need an explicit rule")
    typed, out = known.select("ord", "layer_ord", "value", rule.alias("rule")), None
    present = {r[0] for r in x.measures.select("support_behavior").distinct().collect()}
    present = {unknown if b == "unknown" else b for b in present}
    for behaviour in sorted(present):
        part = aggregate(typed.where(F.col("rule") == behaviour).drop("rule"), m, behaviour, allocation, unmapped)
        out = part if out is None else out.unionByName(part)
    values = out.withColumnRenamed("target_ord", "ord").select("ord", "layer_ord", "value")
    return replace(targets, values=values, layers=x.layers, measures=x.measures, time_axis=x.time_axis).noted("aggregate_to", kind=m.kind)


def aggregate_regions(x: Dataset, membership: DataFrame, **more) -> Dataset:  # noqa: ANN003
    """Layers by region, the regions with support and centroid."""
    from latticework.model import elements_table, ranked

    support = support_size(x).select(F.col("ord").alias("source_ord"), F.coalesce("support", F.lit(1.0)).alias("support"))
    at = membership.join(x.elements.select("ord", "x", "y", "z"), "ord").join(support.withColumnRenamed("source_ord", "ord"), "ord")
    table = ranked(at.groupBy("region_id").agg(*[F.avg(c).alias(c) for c in "xyz"], F.sum("support").alias("support")), "region_id")
    m = from_partition(membership, table.select("ord", "region_id"), support)
    target = replace(x, kind="region", elements=elements_table(table), faces=None, affine=None, dim=None, coordinates={}, roles={}, labels={})
    return aggregate_to(x, target, m, unmapped=more.pop("unmapped", "drop"), **more)


def variance(values: DataFrame, variances: DataFrame, m: SupportMap, behaviour: str, allocation: str = "error", unmapped: str = "error") -> DataFrame:
    """(target_ord, layer_ord, variance) by the delta method: value variance and, if the map has it, weight variance."""
    weights = allocated(m, allocation, unmapped) if behaviour != "intensive" else m.weights
    weights = weights if "weight_var" in weights.columns else weights.withColumn("weight_var", F.lit(0.0))
    met = values.withColumnRenamed("ord", "source_ord").join(variances.select(F.col("ord").alias("source_ord"), "layer_ord", F.col("variance").alias("vv")), ["source_ord", "layer_ord"]).join(weights, "source_ord")
    if behaviour != "intensive":
        term = F.col("weight") ** 2 * F.col("vv") + F.col("value") ** 2 * F.col("weight_var")
        return met.groupBy("target_ord", "layer_ord").agg(F.sum(term).alias("variance"))
    mean = aggregate(values, m, "intensive", allocation, unmapped).withColumnRenamed("value", "mean")
    met = met.join(m.support, "source_ord").join(m.target_support().withColumnRenamed("support", "ts"), "target_ord").join(mean, ["target_ord", "layer_ord"])
    share = F.col("support") / F.col("ts")
    term = (F.col("weight") * share) ** 2 * F.col("vv") + (share * (F.col("value") - F.col("mean"))) ** 2 * F.col("weight_var")
    return met.groupBy("target_ord", "layer_ord").agg(F.sum(term).alias("variance"))


def compose(first: SupportMap, second: SupportMap) -> SupportMap:
    """source -> middle -> target as one map; its type is found from the product."""
    met = first.weights.withColumnRenamed("target_ord", "mid").withColumnRenamed("weight", "w1").join(second.weights.select(F.col("source_ord").alias("mid"), "target_ord", F.col("weight").alias("w2")), "mid")
    weights = cut(met.groupBy("target_ord", "source_ord").agg(F.sum(F.col("w1") * F.col("w2")).alias("weight")), "composed")
    sums = weights.groupBy("source_ord").agg(F.sum("weight").alias("s"), F.count("*").alias("n"))
    row = sums.agg(F.max("s"), F.min("s"), F.max("n"), F.count("*")).first()
    kind = "overlapping" if (row[0] or 0) > 1 + 1e-10 else "crisp" if (row[2] or 0) <= 1 and abs((row[1] or 1) - 1) < 1e-10 else "probabilistic"
    full = row[3] == first.support.count() and abs((row[1] or 0) - 1) < 1e-10
    return SupportMap(weights, first.support, kind, "complete" if full else "partial")


def nearest_map(source: Dataset, target: Dataset, most: float = float("inf"), support: DataFrame | None = None, dims: str = "xyz") -> SupportMap:
    """Each source element to its nearest target, ties to the first."""
    a, b = source.elements.select("ord", *dims), target.elements.select("ord", *dims)
    if most < float("inf"):
        near = within(a, b, most, dims)
        found = near.groupBy("i").agg(F.min_by("j", F.struct("distance", "j")).alias("j"))
    else:
        found = nearest(a, b, 1, dims, same=False)
    weights = found.select(F.col("j").alias("target_ord"), F.col("i").alias("source_ord"), F.lit(1.0).alias("weight"))
    return _built(source, weights, support)


def _built(source: Dataset, weights: DataFrame, support: DataFrame | None, kind: str | None = None) -> SupportMap:
    support = support if support is not None else support_size(source).select(F.col("ord").alias("source_ord"), F.coalesce("support", F.lit(1.0)).alias("support"))
    weights = cut(weights, "map")
    sums = weights.groupBy("source_ord").agg(F.sum("weight").alias("s"), F.count("*").alias("n"))
    row = sums.agg(F.min("s"), F.max("n"), F.count("*")).first()
    complete = row[2] == support.count() and (row[0] is None or row[0] > 1 - 1e-10)
    return SupportMap(weights, support, kind or ("crisp" if (row[1] or 1) == 1 else "probabilistic"), "complete" if complete else "partial")


def barycentric_map(source: Dataset, target: Dataset, candidates: int = 16, support: DataFrame | None = None, tolerance: float = 1e-12) -> SupportMap:
    """Each source vertex to the corners of the nearest target triangle, by the weights of its closest point.

    Exact: triangles are tried in the order of their centroids' distance, first
    ``candidates`` of them. No other triangle can be nearer than its centroid is,
    less the largest reach of a triangle around its centroid; vertices for which
    that leaves a doubt try four times as many, in the end all.
    """
    from .topology import triangles

    faces = triangles(target)
    centre = {c: (F.col("a" + c) + F.col("b" + c) + F.col("c" + c)) / 3 for c in "xyz"}
    reach = F.greatest(*[F.sqrt(sum(((F.col(p + c) - centre[c]) ** 2 for c in "yz"), (F.col(p + "x") - centre["x"]) ** 2)) for p in "abc"])
    faces = cut(faces.withColumn("reach", reach), "faces")
    centres = faces.select(F.col("face_id").alias("ord"), *[e.alias(c) for c, e in centre.items()])
    n, widest = faces.agg(F.count("*"), F.max("reach")).first()
    corner = [f"{p}{c}" for p in "abc" for c in "xyz"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            p = part[["x", "y", "z"]].to_numpy()
            weights, d = closest_on_triangles(p, *np.split(part[corner].to_numpy(), 3, axis=1))
            yield pd.DataFrame({"source_ord": part["ord"], "face_id": part["face_id"], "far": part["far"], "d": d, "w1": weights[:, 0], "w2": weights[:, 1], "w3": weights[:, 2], "v1": part["v1"], "v2": part["v2"], "v3": part["v3"]})

    open_, settled = source.elements.select("ord", "x", "y", F.coalesce("z", F.lit(0.0)).alias("z")), None
    while n:
        near = nearest(open_, centres, candidates, "xyz", same=False).select(F.col("i").alias("ord"), F.col("j").alias("face_id"), F.col("distance").alias("far"))
        met = near.join(open_, "ord").join(faces, "face_id")
        found = met.select("ord", "face_id", "far", "x", "y", "z", *corner, "v1", "v2", "v3").mapInPandas(run, "source_ord long, face_id long, far double, d double, w1 double, w2 double, w3 double, v1 long, v2 long, v3 long")
        best = found.groupBy("source_ord").agg(F.min_by(F.array(*[F.struct(F.col(f"v{k}").alias("v"), F.col(f"w{k}").alias("w")) for k in (1, 2, 3)]), F.struct("d", "face_id")).alias("e"), F.min("d").alias("d"), F.max("far").alias("far"))
        sure = F.lit(candidates >= n) | (F.sqrt("d") < F.col("far") - widest)
        best = cut(best.withColumn("sure", sure), "closest")
        own = best.where("sure").select("source_ord", "e")
        settled = own if settled is None else settled.unionByName(own)
        open_ = cut(open_.join(best.where("not sure").select(F.col("source_ord").alias("ord")), "ord", "left_semi"), "open")
        if not open_.take(1):
            break
        candidates *= 4
    if settled is None:
        raise ValueError("the target has no triangles")
    weights = settled.select("source_ord", F.explode("e").alias("e")).where(F.col("e.w") > tolerance).groupBy(F.col("e.v").alias("target_ord"), "source_ord").agg(F.sum("e.w").alias("weight"))
    return _built(source, weights, support)


def closest_on_triangles(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Barycentric weights of the closest points, and the squared distances: the plane if inside, else the best edge."""
    dot = lambda u, v: np.einsum("ij,ij->i", u, v)
    corners = (a, b, c)
    best, weights = np.full(len(p), np.inf), np.zeros((len(p), 3))
    for k, m in ((0, 1), (1, 2), (0, 2)):
        e = corners[m] - corners[k]
        t = np.clip(dot(p - corners[k], e) / np.maximum(dot(e, e), 1e-300), 0, 1)
        d = ((p - corners[k] - t[:, None] * e) ** 2).sum(1)
        better = d < best
        best[better] = d[better]
        weights[better] = 0
        weights[better, k], weights[better, m] = 1 - t[better], t[better]
    u, v, w = b - a, c - a, p - a
    uu, uv, vv, wu, wv = dot(u, u), dot(u, v), dot(v, v), dot(w, u), dot(w, v)
    area = uu * vv - uv * uv
    with np.errstate(divide="ignore", invalid="ignore"):
        s, t = (vv * wu - uv * wv) / area, (uu * wv - uv * wu) / area
    inside = (area > 1e-300) & (s >= 0) & (t >= 0) & (s + t <= 1)
    d = ((w - s[:, None] * u - t[:, None] * v) ** 2).sum(1)
    weights[inside] = np.stack([1 - s - t, s, t], axis=1)[inside]
    best[inside] = d[inside]
    return weights, best


def _lattice(source: Dataset, target: Dataset) -> DataFrame:
    """Source voxels with their continuous coordinates (u, v, w) on the target lattice."""
    m = np.linalg.inv(np.asarray(target.affine)) @ np.asarray(source.affine)
    cols = [sum((float(r[n]) * F.col(c) for n, c in enumerate("ijk")), F.lit(float(r[3]))).alias(o) for r, o in zip(m, "uvw", strict=False)]
    return source.elements.select(F.col("ord").alias("source_ord"), *cols)


def _outside(found: DataFrame, sources: DataFrame, outside: str, tolerance: float) -> DataFrame:
    """found (target_ord, source_ord, weight): what to do where the weights of a source do not reach 1."""
    if outside == "normalize":
        return found.join(found.groupBy("source_ord").agg(F.sum("weight").alias("s")), "source_ord").withColumn("weight", F.col("weight") / F.col("s")).drop("s")
    sums = sources.select("source_ord").join(found.groupBy("source_ord").agg(F.sum("weight").alias("s")), "source_ord", "left")
    if outside == "error" and sums.where(F.coalesce("s", F.lit(0.0)) < 1 - tolerance).take(1):
        raise ValueError("sources reach outside the target lattice")
    return found


def affine_grid_map(source: Dataset, target: Dataset, method: str = "nearest", outside: str = "error", tolerance: float = 1e-10, support: DataFrame | None = None) -> SupportMap:
    """Source voxels to the nearest target voxel, or to eight by trilinear weights."""
    at = _lattice(source, target)
    if method == "nearest":
        cells = at.select("source_ord", *[F.floor(F.col(c) + 0.5).cast("int").alias(o) for c, o in zip("uvw", "ijk", strict=True)], F.lit(1.0).alias("weight"))
    else:
        parts = at.select("source_ord", *[F.floor(F.round(c, 10)).cast("int").alias("f" + c) for c in "uvw"], *[(F.col(c) - F.floor(F.round(c, 10))).alias("r" + c) for c in "uvw"])
        corners = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, "uvw", strict=True)]) for o in itertools.product((0, 1), repeat=3)])
        each = parts.withColumn("o", F.explode(corners))
        share = [F.when(F.col(f"o.{c}") == 1, F.col("r" + c)).otherwise(1 - F.col("r" + c)) for c in "uvw"]
        cells = each.select("source_ord", *[(F.col("f" + c) + F.col(f"o.{c}")).alias(o) for c, o in zip("uvw", "ijk", strict=True)], (share[0] * share[1] * share[2]).alias("weight")).where(F.col("weight") > tolerance)
    found = cells.join(target.elements.select(F.col("ord").alias("target_ord"), "i", "j", "k"), ["i", "j", "k"]).select("target_ord", "source_ord", "weight")
    return _built(source, _outside(found, at, outside, tolerance), support)


def voxel_overlap_map(source: Dataset, target: Dataset, outside: str = "error", tolerance: float = 1e-10, support: DataFrame | None = None) -> SupportMap:
    """Source voxels to all target voxels they overlap, by the share of their volume; the lattices' axes must be parallel."""
    m = np.linalg.inv(np.asarray(target.affine)) @ np.asarray(source.affine)
    if np.abs(m[:3, :3] - np.diag(np.diag(m[:3, :3]))).max() > 1e-9:
        raise ValueError("overlaps need parallel axes")
    at, half = _lattice(source, target), np.abs(np.diag(m[:3, :3])) / 2
    for c, h in zip("uvw", half, strict=True):
        h = float(h)
        spans = F.sequence(F.floor(F.col(c) - h + 0.5 + tolerance).cast("int"), F.ceil(F.col(c) + h - 0.5 - tolerance).cast("int"))
        at = at.withColumn("g" + c, F.explode(spans))
        overlap = F.least(F.col(c) + h, F.col("g" + c) + 0.5) - F.greatest(F.col(c) - h, F.col("g" + c) - 0.5)
        at = at.withColumn("s" + c, overlap / (2 * h))
    cells = at.select("source_ord", *[F.col("g" + c).alias(o) for c, o in zip("uvw", "ijk", strict=True)], (F.col("su") * F.col("sv") * F.col("sw")).alias("weight")).where(F.col("weight") > tolerance)
    found = cells.join(target.elements.select(F.col("ord").alias("target_ord"), "i", "j", "k"), ["i", "j", "k"]).select("target_ord", "source_ord", "weight")
    return _built(source, _outside(found, source.elements.select(F.col("ord").alias("source_ord")), outside, tolerance), support, "probabilistic")


def atlas_overlap(first: SupportMap, second: SupportMap, method: str = "intersection") -> DataFrame:
    """(first_ord, second_ord, value): shared support, or its Jaccard or Dice share."""
    a = first.weights.select(F.col("target_ord").alias("first_ord"), "source_ord", F.col("weight").alias("wa"))
    b = second.weights.select(F.col("target_ord").alias("second_ord"), "source_ord", F.col("weight").alias("wb"))
    both = a.join(b, "source_ord").join(first.support, "source_ord").groupBy("first_ord", "second_ord").agg(F.sum(F.col("wa") * F.col("wb") * F.col("support")).alias("value"))
    if method == "intersection":
        return both
    both = both.join(first.target_support().select(F.col("target_ord").alias("first_ord"), F.col("support").alias("sa")), "first_ord").join(second.target_support().select(F.col("target_ord").alias("second_ord"), F.col("support").alias("sb")), "second_ord")
    share = F.col("value") / (F.col("sa") + F.col("sb") - F.col("value")) if method == "jaccard" else 2 * F.col("value") / (F.col("sa") + F.col("sb"))
    return both.select("first_ord", "second_ord", share.alias("value"))


def atlas_compare(first: SupportMap, second: SupportMap) -> DataFrame:
    """(first_ord, second_ord, dice): the best match of every region, ties to the first."""
    dice = atlas_overlap(first, second, "dice")
    return dice.groupBy("first_ord").agg(F.max_by("second_ord", F.struct("value", (-F.col("second_ord")).alias("o"))).alias("second_ord"), F.max("value").alias("dice"))


def cross_atlas(values: DataFrame, first: SupportMap, second: SupportMap, semantics: str = "intensive") -> DataFrame:
    """Region values (ord, value) of one atlas on another, as constant inside the first's regions."""
    return _transfer(values, first, second, semantics == "intensive")


def _transfer(values: DataFrame, first: SupportMap, second: SupportMap, intensive: bool) -> DataFrame:
    shared = atlas_overlap(first, second).withColumnRenamed("value", "shared")
    met = shared.join(values.select(F.col("ord").alias("first_ord"), "value"), "first_ord")
    if intensive:
        out = met.groupBy("second_ord").agg(F.try_divide(F.sum(F.col("shared") * F.col("value")), F.sum("shared")).alias("value"))
    else:
        own = first.target_support().select(F.col("target_ord").alias("first_ord"), F.col("support").alias("s"))
        out = met.join(own, "first_ord").groupBy("second_ord").agg(F.sum(F.col("value") * F.col("shared") / F.col("s")).alias("value"))
    return out.select(F.col("second_ord").alias("ord"), "value")


def entropy(m: SupportMap, normalized: bool = True) -> DataFrame:
    """(source_ord, entropy) of each source's shares."""
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("source_ord"))
    found = m.weights.where("weight > 0").withColumn("p", share).groupBy("source_ord").agg(F.sum(-F.col("p") * F.log("p")).alias("entropy"))
    if normalized:
        n = m.weights.agg(F.countDistinct("target_ord")).first()[0]
        found = found.withColumn("entropy", F.col("entropy") / float(np.log(n)) if n and n > 1 else F.lit(0.0))
    return found


def diagnostics(m: SupportMap, tolerance: float = 1e-10) -> DataFrame:
    """(name, value): size, coverage, conservation and spread of a map, in one row for each figure."""
    sums = m.support.join(m.weights.groupBy("source_ord").agg(F.sum("weight").alias("s"), F.count("*").alias("n")), "source_ord", "left").fillna(0, ["s", "n"])
    a = sums.agg(F.count("*").alias("sources"), F.count_if(F.col("n") > 0).alias("mapped_sources"), F.count_if(F.col("n") == 0).alias("unmapped_sources"), F.count_if(F.abs(F.col("s") - 1) <= tolerance).alias("conserved_sources"), F.min("s").alias("least_sum"), F.max("s").alias("largest_sum"), F.avg("n").alias("mean_targets"), F.max("n").alias("most_targets"), F.sum("support").alias("source_support"), F.sum(F.col("support") * F.col("s")).alias("mapped_support"))
    b = m.weights.agg(F.count("*").alias("entries"), F.countDistinct("target_ord").alias("targets"), F.min("weight").alias("least_weight"), F.max("weight").alias("largest_weight"))
    c = entropy(m).agg(F.avg("entropy").alias("mean_entropy"), F.max("entropy").alias("largest_entropy"))
    d = m.target_support().agg(F.min("support").alias("least_target_support"), F.max("support").alias("largest_target_support"))
    rows = [(k, float(v) if v is not None else None) for df in (a, b, c, d) for k, v in df.first().asDict().items()]
    return m.weights.sparkSession.createDataFrame(rows, "name string, value double")


def condition(m: SupportMap, iterations: int = 30) -> dict[str, float]:
    """Largest singular value by power iteration and stable rank, with joins alone: the operator is never dense."""
    total = m.weights.agg(F.sum(F.col("weight") ** 2)).first()[0] or 0.0
    v = cut(m.weights.select("source_ord").distinct().withColumn("v", F.lit(1.0)), "power")
    sigma = 0.0
    for _ in range(iterations):
        u = m.weights.join(v, "source_ord").groupBy("target_ord").agg(F.sum(F.col("weight") * F.col("v")).alias("u"))
        back = cut(m.weights.join(u, "target_ord").groupBy("source_ord").agg(F.sum(F.col("weight") * F.col("u")).alias("v")), "power")
        norm = (back.agg(F.sum(F.col("v") ** 2)).first()[0] or 0.0) ** 0.5
        if not norm:
            break
        before, sigma = sigma, norm**0.5
        v = back.withColumn("v", F.col("v") / norm)
        if abs(sigma - before) <= 1e-12 * sigma:
            break
    return {"sigma_max": sigma, "frobenius": total**0.5, "stable_rank": total / sigma**2 if sigma else 0.0}


def sensitivity(x: Dataset, targets: Dataset, maps: list[SupportMap], behaviour: str, layer: int | str = 0, reference: int = 0) -> DataFrame:
    """(map, rmse, largest): how far each map's aggregate is from the reference's."""
    values = x.layer(layer).withColumn("layer_ord", F.lit(0))
    got = [aggregate(values, m, behaviour, "normalize", "drop").select("target_ord", "value") for m in maps]
    rows = None
    for n, one in enumerate(got):
        gap = one.join(got[reference].withColumnRenamed("value", "ref"), "target_ord").select((F.col("value") - F.col("ref")).alias("d"))
        row = gap.agg(F.lit(n).alias("map"), F.sqrt(F.avg(F.col("d") ** 2)).alias("rmse"), F.max(F.abs("d")).alias("largest"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


def monte_carlo(m: SupportMap, draws: int = 100, seed: int = 0, normalization: str = "column") -> DataFrame:
    """(draw, target_ord, source_ord, weight): maps with weights drawn around their variance, none below zero."""
    each = m.weights.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    # two hashed uniforms of draw, entry and seed: the same whatever the partitioning
    u = [(F.pmod(F.xxhash64(F.lit(seed + n), "draw", "target_ord", "source_ord"), F.lit(1 << 52)) + 0.5) / float(1 << 52) for n in (0, 1)]
    noise = F.sqrt(-2 * F.log(u[0])) * F.cos(2 * np.pi * u[1])
    each = each.withColumn("weight", F.greatest(F.lit(0.0), F.col("weight") + noise * F.sqrt(F.coalesce("weight_var", F.lit(0.0)))))
    if normalization == "column":
        each = each.withColumn("weight", F.try_divide("weight", F.sum("weight").over(Window.partitionBy("draw", "source_ord"))))
    return each.select("draw", "target_ord", "source_ord", "weight")


def uncertainty(m: SupportMap, covariance: DataFrame, output: str = "diagonal") -> DataFrame:
    """Variance or covariance of intensive targets from a value covariance (i, j, value), both triangles given.

    ``L S L'`` by two joins, with rows of L as shares of target support.
    """
    shares = m.weights.join(m.support, "source_ord").withColumn("l", F.col("weight") * F.col("support")).withColumn("l", F.col("l") / F.sum("l").over(Window.partitionBy("target_ord"))).select("target_ord", "source_ord", "l")
    left = covariance.join(shares.select(F.col("target_ord").alias("a"), F.col("source_ord").alias("i"), F.col("l").alias("li")), "i").groupBy("a", "j").agg(F.sum(F.col("li") * F.col("value")).alias("value"))
    full = left.join(shares.select(F.col("target_ord").alias("b"), F.col("source_ord").alias("j"), F.col("l").alias("lj")), "j")
    full = full.where("a = b") if output == "diagonal" else full
    out = full.groupBy("a", "b").agg(F.sum(F.col("value") * F.col("lj")).alias("value"))
    return out.select(F.col("a").alias("target_ord"), F.col("value").alias("variance")) if output == "diagonal" else out


def covariance_violations(covariance: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """(rule, i, j): negative variances, missing mirror entries, and pairs beyond what their variances allow."""
    diagonal = covariance.where("i = j").select("i", F.col("value").alias("v"))
    bad = diagonal.where("v < 0").select(F.lit("negative").alias("rule"), "i", F.col("i").alias("j"))
    mirror = covariance.alias("a").join(covariance.alias("b"), (F.col("a.i") == F.col("b.j")) & (F.col("a.j") == F.col("b.i")), "left").where(F.col("b.value").isNull() | (F.abs(F.col("a.value") - F.col("b.value")) > tolerance))
    bound = covariance.join(diagonal.withColumnRenamed("v", "vi"), "i").join(diagonal.select(F.col("i").alias("j"), F.col("v").alias("vj")), "j").where(F.col("value") ** 2 > F.col("vi") * F.col("vj") + tolerance)
    return bad.unionByName(mirror.select(F.lit("symmetry").alias("rule"), F.col("a.i").alias("i"), F.col("a.j").alias("j"))).unionByName(bound.select(F.lit("bound").alias("rule"), "i", "j"))


@dataclass(frozen=True)
class Ensemble:
    """Maps on the same bases with weights that sum to 1."""

    maps: tuple[SupportMap, ...]
    weights: tuple[float, ...]
    kind: str = "operator"


def ensemble(maps: list[SupportMap], weights: list[float] | None = None, kind: str = "operator") -> Ensemble:
    """kind: operator, registration or segmentation."""
    if kind not in ("operator", "registration", "segmentation"):
        raise ValueError(f"unknown kind of ensemble {kind!r}")
    own = weights or [1.0] * len(maps)
    if len(own) != len(maps) or min(own) < 0 or not sum(own):
        raise ValueError("an ensemble needs one non-negative weight for each map")
    return Ensemble(tuple(maps), tuple(w / sum(own) for w in own), kind)


def boundary_sensitivity(maps: list[SupportMap], reference: int = 0) -> DataFrame:
    """(map, disagreement, entropy_change): share of support assigned elsewhere than in the reference."""
    best = lambda m: m.weights.groupBy("source_ord").agg(F.max_by("target_ord", F.struct("weight", (-F.col("target_ord")).alias("o"))).alias("t"))
    base, level, rows = best(maps[reference]).withColumnRenamed("t", "r"), entropy(maps[reference]).agg(F.avg("entropy")).first()[0], []
    for n, m in enumerate(maps):
        met = best(m).join(base, "source_ord", "full").join(maps[reference].support, "source_ord")
        share = met.agg(F.sum(F.when(~F.col("t").eqNullSafe(F.col("r")), F.col("support")).otherwise(0.0)) / F.sum("support")).first()[0]
        rows.append((n, float(share or 0.0), float((entropy(m).agg(F.avg("entropy")).first()[0] or 0.0) - (level or 0.0))))
    return maps[0].weights.sparkSession.createDataFrame(rows, "map int, disagreement double, entropy_change double")


@dataclass(frozen=True)
class OperatorGraph:
    """Support maps between named bases: edges (from, to, id)."""

    edges: tuple[tuple[str, str, str], ...]
    maps: dict[str, SupportMap]

    def path(self, start: str, end: str, ids: list[str] | None = None) -> SupportMap:
        """The composed map along given edges or the only path; two paths are an error."""
        if ids is None:
            found = [*self._paths(start, end, (start,))]
            if len(found) != 1:
                raise ValueError(f"{len(found)} paths from {start} to {end}")
            ids = found[0]
        out = self.maps[ids[0]]
        for k in ids[1:]:
            out = compose(out, self.maps[k])
        return out

    def _paths(self, at: str, end: str, seen: tuple[str, ...]) -> Iterator[list[str]]:
        if at == end:
            yield []
            return
        for a, b, k in self.edges:
            if a == at and b not in seen:
                for rest in self._paths(b, end, (*seen, b)):
                    yield [k, *rest]


@dataclass(frozen=True)
class ResamplingPlan:
    """How one volume or surface is brought to another, fixed before it is done."""

    method: str
    coverage: str = "error"
    conservation: str = "strict"
    missing: str = "error"
    unknown: str = "error"

    def __post_init__(self):
        if self.method not in ("nearest", "trilinear", "overlap", "vertex_nearest", "barycentric"):
            raise ValueError(f"unknown method {self.method!r}")

    def build(self, source: Dataset, target: Dataset) -> SupportMap:
        if self.method in ("nearest", "trilinear"):
            return affine_grid_map(source, target, self.method, self.coverage)
        if self.method == "overlap":
            return voxel_overlap_map(source, target, self.coverage)
        return nearest_map(source, target) if self.method == "vertex_nearest" else barycentric_map(source, target)

    def resample(self, source: Dataset, target: Dataset, authorize: bool = False) -> Dataset:
        if not authorize:
            raise PermissionError("resampling changes what values mean: authorise it")
        if self.missing == "drop":
            source = replace(source, values=source.values.where(F.col("value").isNotNull() & ~F.isnan("value")))
        return aggregate_to(source, target, self.build(source, target), "normalize" if self.conservation == "normalize" else "error", "drop" if self.coverage == "drop" else "error", self.unknown)
