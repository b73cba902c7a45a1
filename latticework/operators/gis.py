"""Landscapes, resistance, point patterns, hotspots and regionalisation on a base."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions import numeric
from latticework.model import sha256, table_hash
from latticework.storage import collected, cut

from .graph import MOST_EDGES, components, shortest
from .reach import Counts, meet, tiled
from .statistics import Permutations, draws
from .topology import within

#: Elements up to which a dense inverse or spectrum is made.
DENSE = 2000


# --- landscapes


def landscape(values: DataFrame, edges: DataFrame, threshold: float = 0.9, kind: str = "quantile", tail: str = "high") -> DataFrame:
    """(ord, active, patch, gradient): elements beyond a threshold, their connected patches, RMS difference from neighbours."""
    cut_ = values.agg(F.percentile("value", F.lit(threshold if tail == "high" else 1 - threshold))).first()[0] if kind == "quantile" else threshold
    on = values.withColumn("active", F.col("value") >= cut_ if tail == "high" else F.col("value") <= cut_)
    inside = on.where("active").select("ord")
    kept = edges.join(inside.withColumnRenamed("ord", "i"), "i", "left_semi").join(inside.withColumnRenamed("ord", "j"), "j", "left_semi")
    patches = components(kept.select("i", "j"), inside).select("ord", F.col("component").alias("patch"))
    met = edges.join(values.select(F.col("ord").alias("i"), F.col("value").alias("vi")), "i").join(values.select(F.col("ord").alias("j"), F.col("value").alias("vj")), "j")
    gradient = met.groupBy(F.col("i").alias("ord")).agg(F.sqrt(F.avg((F.col("vi") - F.col("vj")) ** 2)).alias("gradient"))
    return on.join(patches, "ord", "left").join(gradient, "ord", "left").select("ord", "active", "patch", "gradient")


def patch_table(found: DataFrame, support: DataFrame) -> DataFrame:
    """(patch, elements, support)."""
    return found.where("patch is not null").join(support, "ord").groupBy("patch").agg(F.count("*").alias("elements"), F.sum("support").alias("support"))


def boundary_edges(values: DataFrame, edges: DataFrame, quantile: float = 0.9) -> DataFrame:
    """(i, j, difference) for i < j with a difference in the top share."""
    met = edges.where("i < j").select("i", "j").join(values.select(F.col("ord").alias("i"), F.col("value").alias("vi")), "i").join(values.select(F.col("ord").alias("j"), F.col("value").alias("vj")), "j")
    met = met.select("i", "j", F.abs(F.col("vi") - F.col("vj")).alias("difference"))
    return met.where(F.col("difference") >= met.agg(F.percentile("difference", F.lit(quantile))).first()[0])


def overlap(active: DataFrame) -> DataFrame:
    """(a, b, jaccard) of the active elements (ord, layer_ord) of layers."""
    size = active.groupBy("layer_ord").agg(F.count("*").alias("n"))
    met = active.select("ord", F.col("layer_ord").alias("a")).join(active.select("ord", F.col("layer_ord").alias("b")), "ord").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    met = met.join(F.broadcast(size.select(F.col("layer_ord").alias("a"), F.col("n").alias("na"))), "a").join(F.broadcast(size.select(F.col("layer_ord").alias("b"), F.col("n").alias("nb"))), "b")
    return met.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


# --- resistance


def resistance_edges(values: DataFrame, edges: DataFrame, interpretation: str = "barrier", beta: float = 1.0) -> DataFrame:
    """(i, j, length, conductance): mean surface value of the ends as a barrier or as conductance."""
    met = edges.select("i", "j").join(values.select(F.col("ord").alias("i"), F.col("value").alias("vi")), "i").join(values.select(F.col("ord").alias("j"), F.col("value").alias("vj")), "j")
    mean = (F.col("vi") + F.col("vj")) / 2
    length = F.exp(beta * mean) if interpretation == "barrier" else F.exp(-beta * mean)
    return met.select("i", "j", length.alias("length"), (1 / length).alias("conductance"))


def resistance_distance(resist: DataFrame, n: int, pairs: DataFrame, method: str = "least_cost", time: float = 1.0) -> DataFrame:
    """(source, target, distance) of pairs: least cost paths, effective resistance, or heat diffusion.

    Paths run source by source on the executors; the other two take a dense
    spectrum and so a checked number of elements.
    """
    if method == "least_cost":
        sources = pairs.select(F.col("source").alias("ord")).distinct()
        return pairs.join(shortest(resist, n, sources), ["source", "target"], "left").select("source", "target", "distance")
    if n > DENSE:
        raise ValueError(f"{n} elements; a dense spectrum takes {DENSE}")
    t = collected(resist)
    a = np.zeros((n, n))
    a[t["i"], t["j"]] = t["conductance"]
    lam, u = np.linalg.eigh(np.diag(a.sum(1)) - a)
    p = collected(pairs)
    gap = u[p["source"]] - u[p["target"]]
    if method == "effective_resistance":
        keep = lam > 1e-10 * max(lam.max(), 1e-300)
        d = (gap[:, keep] ** 2 / lam[keep]).sum(1)
        d[(np.abs(gap[:, ~keep]) > 1e-8).any(1)] = math.inf
    else:
        d = np.sqrt((gap**2 * np.exp(-2 * time * lam)).sum(1))
    return pairs.sparkSession.createDataFrame(p.assign(distance=d)[["source", "target", "distance"]])


# --- point patterns


def pair_enrichment(events: DataFrame, domain: DataFrame, radii: list[float], dims: str = "xyz") -> DataFrame:
    """(radius, observed, expected, enrichment): event pairs within each radius against the domain's own pairs.

    events (ord, n) count events at domain elements; a finite domain needs no
    edge correction.
    """
    totals = events.agg(F.sum("n").alias("n")).first()["n"]
    size, spark = domain.count(), domain.sparkSession
    own = cut(domain.select("ord", *dims).join(events.select("ord", "n"), "ord", "left").fillna(0, ["n"]), "domain")
    found = meet(tiled(own, dims), own.drop(*dims), own, max(radii), lambda: Counts(sorted({float(r) for r in radii})), "radius double, observed double, pairs long", half=True)
    each = found.groupBy("radius").agg((2 * F.sum("observed")).alias("observed"), (2 * F.sum("pairs")).alias("pairs"))
    out = each.join(F.broadcast(spark.createDataFrame([(float(r),) for r in radii], "radius double")), "radius").where("pairs > 0")
    expected = F.col("pairs") * float(totals) ** 2 / float(size * size)
    return out.select("radius", "observed", expected.alias("expected"), F.try_divide("observed", expected).alias("enrichment"))


def enrichment_envelope(events: DataFrame, domain: DataFrame, radii: list[float], simulations: int = 199, seed: int = 0, level: float = 0.95, dims: str = "xyz", exposure: str | None = None) -> DataFrame:
    """(radius, observed, low, high, p_value): events thrown at random on the domain (by exposure), draws over tasks."""
    near = within(domain, domain, max(radii), dims).where("i <> j")
    order = collected(domain.orderBy("ord"))
    at = {int(o): k for k, o in enumerate(order["ord"])}
    t, e = collected(near), collected(events)
    i, j, d = np.array([at[int(v)] for v in t["i"]]), np.array([at[int(v)] for v in t["j"]]), t["distance"].to_numpy()
    n = np.zeros(len(order))
    n[[at[int(v)] for v in e["ord"]]] = e["n"]
    share = order[exposure].to_numpy(dtype=float) if exposure else np.ones(len(order))
    sent = domain.sparkSession.sparkContext.broadcast((i, j, d, share / share.sum(), int(n.sum())))

    def count(n: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> list[float]:
        both = n[i] * n[j]
        return [float(both[d <= r].sum()) for r in radii]

    def run(_: int, rng: np.random.Generator) -> list[tuple]:
        i, j, d, share, total = sent.value
        return list(zip(map(float, radii), count(rng.multinomial(total, share).astype(float), i, j, d), strict=True))

    found = draws(domain.sparkSession, simulations, seed, run, "radius double, observed double").toPandas()
    rows = []
    for r, o in zip(radii, count(n, i, j, d), strict=True):
        null = found.loc[found["radius"] == r, "observed"].to_numpy()
        rows.append((float(r), o, float(np.quantile(null, (1 - level) / 2)), float(np.quantile(null, (1 + level) / 2)), float(numeric.permutation_p(o, null, 0.0, "greater"))))
    return domain.sparkSession.createDataFrame(rows, "radius double, observed double, low double, high double, p_value double")


# --- hotspots in space and time


def hotspots(v: DataFrame, spatial: DataFrame, bandwidth: float = 1.0, temporal_bandwidth: float = 1.0, interaction: float = 1.0, cutoff: float | None = None) -> DataFrame:
    """(ord, time_ord, z): Gi* under the non-separable kernel exp(-s - t - eta s t).

    v (ord, time_ord, time, value); spatial (i, j, distance) within reach,
    without the elements themselves.
    """
    reach = cutoff if cutoff is not None else 3.0
    own = v.select(F.col("ord").alias("i")).distinct().select("i", F.col("i").alias("j"), F.lit(0.0).alias("distance"))
    near = spatial.select("i", "j", "distance").unionByName(own).withColumn("s", F.col("distance") / bandwidth).where(F.col("s") <= reach)
    times = v.select(F.col("time_ord").alias("t1"), F.col("time").alias("x1")).distinct()
    gaps = times.join(F.broadcast(times.select(F.col("t1").alias("t2"), F.col("x1").alias("x2"))), F.lit(True)).withColumn("t", F.abs(F.col("x1") - F.col("x2")) / temporal_bandwidth).where(F.col("t") <= reach)
    met = near.join(v.select(F.col("ord").alias("j"), F.col("time_ord").alias("t2"), "value"), "j").join(F.broadcast(gaps.select("t1", "t2", "t")), "t2")
    w = F.exp(-F.col("s") - F.col("t") - interaction * F.col("s") * F.col("t"))
    sums = met.groupBy(F.col("i").alias("ord"), F.col("t1").alias("time_ord")).agg(F.sum(w * F.col("value")).alias("top"), F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"))
    stats = v.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    n = F.col("n")
    below = F.col("sd") * F.sqrt((n * F.col("sw2") - F.col("sw") ** 2) / (n - 1))
    return sums.join(F.broadcast(stats), F.lit(True)).select("ord", "time_ord", F.try_divide(F.col("top") - F.col("mean") * F.col("sw"), below).alias("z"))


def hotspot_test(v: DataFrame, spatial: DataFrame, bandwidth: float = 1.0, temporal_bandwidth: float = 1.0, interaction: float = 1.0, cutoff: float | None = None, control: Permutations = Permutations()) -> DataFrame:  # noqa: B008
    """``hotspots`` with p_value and p_max: whole series move between the elements, p_max holds against the largest |z| of each draw.

    The kernel's weights go to the tasks once, after their number is checked;
    draws are spread and send back counts alone. Every element needs a value at
    every point of time.
    """
    reach = cutoff if cutoff is not None else 3.0
    table = collected(v.select("ord", "time_ord", "time", "value")).sort_values(["ord", "time_ord"])
    x = table.pivot(index="ord", columns="time_ord", values="value")
    if x.isna().to_numpy().any():
        raise ValueError("elements without a value at some time")
    times = table.drop_duplicates("time_ord").sort_values("time_ord")["time"].to_numpy()
    at, n, nt = {o: k for k, o in enumerate(x.index)}, len(x), len(times)
    pairs = collected(spatial.select("i", "j", "distance"))
    i, j = (np.concatenate([pairs[c].map(at).to_numpy(dtype=np.int64), np.arange(n)]) for c in "ij")
    s = np.concatenate([pairs["distance"].to_numpy(dtype=float) / bandwidth, np.zeros(n)])
    i, j, s = i[s <= reach], j[s <= reach], s[s <= reach]
    t = np.abs(times[:, None] - times[None]) / temporal_bandwidth
    if (cells := len(s) * nt * nt) > MOST_EDGES:
        raise ValueError(f"{cells} weights; a task can be sent {MOST_EDGES}")
    w = np.exp(-s[:, None, None] - t[None] - interaction * s[:, None, None] * t[None]) * (t <= reach)[None]
    sent = v.sparkSession.sparkContext.broadcast((x.to_numpy(dtype=float), i, j, w))

    def scores(values: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
        sums = [np.zeros(values.shape) for _ in range(3)]
        for out, each in zip(sums, (np.einsum("kab,kb->ka", w, values[j]), w.sum(2), (w * w).sum(2)), strict=True):
            np.add.at(out, i, each)
        m = values.size
        with np.errstate(divide="ignore", invalid="ignore"):
            return (sums[0] - values.mean() * sums[1]) / (values.std() * np.sqrt((m * sums[2] - sums[1] ** 2) / (m - 1)))

    observed = scores(*sent.value)
    held = v.sparkSession.sparkContext.broadcast(np.abs(observed))

    def run(_: int, rng: np.random.Generator) -> list[tuple]:
        values, i, j, w = sent.value
        z = np.abs(scores(values[rng.permutation(len(values))], i, j, w))
        return list(zip(range(z.size), (z >= held.value).ravel().astype(int).tolist(), (np.nanmax(z) >= held.value).ravel().astype(int).tolist(), strict=True))

    counts = draws(v.sparkSession, control.draws, control.seed, run, "place long, alone long, largest long").groupBy("place").agg(F.sum("alone").alias("alone"), F.sum("largest").alias("largest"))
    named = v.sparkSession.createDataFrame([(k, int(o), int(tt), float(observed[k // nt, k % nt])) for k, (o, tt) in enumerate((o, tt) for o in x.index for tt in x.columns)], "place long, ord long, time_ord int, z double")
    p = lambda c: ((F.coalesce(F.col(c), F.lit(0)) + 1) / (control.draws + 1.0)).alias
    return named.join(counts, "place", "left").select("ord", "time_ord", "z", p("alone")("p_value"), p("largest")("p_max"))


def hotspot_classes(z: DataFrame, threshold: float = 1.96, persistent: float = 0.9) -> DataFrame:
    """(ord, class): none, historical, new, persistent, consecutive or recurrent, in this order of precedence."""
    row = z.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("time_ord", (F.col("z") >= threshold).cast("int").alias("hot")))).alias("e")).select("ord", F.col("e.hot").alias("h"))
    n, total = F.size("h"), F.aggregate("h", F.lit(0), lambda s, x: s + x)
    last = F.element_at("h", -1) == 1
    text = F.array_join(F.transform("h", lambda x: x.cast("string")), "")
    found = F.when(total == 0, "none").when(~last, "historical").when((total == 1) & last, "new").when(total >= persistent * n, "persistent").when(text.rlike("^0*1+$"), "consecutive").otherwise("recurrent")
    return row.select("ord", found.alias("class"))


def hotspot_features(z: DataFrame, unit: str = "unit_id", threshold: float = 1.96) -> DataFrame:
    """(unit, mean_z, max_abs_z, hot_fraction, trend) of each unit's results."""
    return z.groupBy(unit).agg(F.avg("z").alias("mean_z"), F.max(F.abs("z")).alias("max_abs_z"), F.avg((F.col("z") >= threshold).cast("double")).alias("hot_fraction"), F.regr_slope("z", F.col("time_ord").cast("double")).alias("trend"))


# --- regionalisation


def regionalise(features: DataFrame, edges: DataFrame, layers: list[str], n_regions: int, min_elements: int = 1) -> DataFrame:
    """(ord, region): a minimum spanning tree on feature distance, cut at its longest edges that leave large enough sides.

    A cut is taken only if the asked number of regions can still be reached; if
    the tree cannot give that many of that size at all, that is an error. The
    features of the ends are joined to the edges; the tree and its cuts run on
    the driver over a checked number of edges.
    """
    met = edges.where("i < j").select("i", "j")
    for end in "ij":
        met = met.join(features.select(F.col("ord").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in layers]), end)
    length = F.sqrt(sum(((F.col(f"{c}_i") - F.col(f"{c}_j")) ** 2 for c in layers[1:]), (F.col(f"{layers[0]}_i") - F.col(f"{layers[0]}_j")) ** 2))
    t = collected(met.select("i", "j", length.alias("d")), MOST_EDGES).sort_values(["d", "i", "j"])
    nodes = np.sort(collected(features.select("ord"), MOST_EDGES)["ord"].to_numpy()).tolist()
    root = {o: o for o in nodes}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    tree = []
    for i, j, d in zip(t["i"].tolist(), t["j"].tolist(), t["d"].tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            tree.append((d, i, j))
    kept = _cut_tree(nodes, tree, n_regions, min_elements)
    spark = features.sparkSession
    # what is left is a forest on the driver already: its parts need no rounds of joins
    root.update((o, o) for o in nodes)
    for _, i, j in kept:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    numbers = np.unique(np.array([find(o) for o in nodes], dtype=np.int64), return_inverse=True)[1]
    found = spark.createDataFrame(pa.table({"ord": np.array(nodes, dtype=np.int64), "region": numbers.astype(np.int64) + 1}))
    return found.select(F.col("ord").cast(features.schema["ord"].dataType), "region")


def _cut_tree(nodes: list[int], tree: list[tuple[float, int, int]], n_regions: int, least: int) -> list[tuple[float, int, int]]:
    """The edges that stay of a forest (length, i, j) cut into ``n_regions`` parts of at least ``least`` nodes."""
    near: dict[int, list[int]] = {o: [] for o in nodes}
    for _, i, j in tree:
        near[i].append(j)
        near[j].append(i)
    # parents before children, from the least node of each component
    above: dict[int, int | None] = {}
    order: list[int] = []
    for start in nodes:
        if start not in above:
            above[start] = None
            stack = [start]
            while stack:
                at = stack.pop()
                order.append(at)
                for v in near[at]:
                    if v not in above:
                        above[v] = at
                        stack.append(v)
    cuts: set[int] = set()

    def parts(extra: int | None = None) -> int:
        """How many parts of the least size the forest can give, all cuts so far taken; -1 if a part is too small already."""
        size, made = dict.fromkeys(nodes, 1), 0
        for v in reversed(order):
            up = above[v]
            if up is None or v in cuts or v == extra:
                # what is below a cut or a root is a part by itself, or goes with the last one cut below it
                if size[v] < least and not below.get(v):
                    return -1
                made += size[v] >= least
                below[v] = 0
            elif size[v] >= least:
                made += 1
                below[up] = below.get(up, 0) + 1
            else:
                size[up] += size[v]
                below[up] = below.get(up, 0) + below.get(v, 0)
        return made

    below: dict[int, int] = {}
    now = sum(above[o] is None for o in nodes)
    if parts() < n_regions:
        raise ValueError(f"the tree cannot be cut into {n_regions} regions of at least {least} elements")
    for _, i, j in sorted(tree, key=lambda e: (-e[0], e[1:])):
        if now >= n_regions:
            break
        child = j if above[j] == i else i
        below = {}
        if parts(child) >= n_regions:
            cuts.add(child)
            now += 1
    if now > n_regions:
        raise ValueError(f"the graph has {now} components; {n_regions} regions were asked for")
    return [e for e in tree if (e[2] if above[e[2]] == e[1] else e[1]) not in cuts]


def freeze(membership: DataFrame, training: DataFrame) -> dict:
    """A membership sealed with the hashes of itself and of the values it was found on."""
    return {"membership": membership, "seal": table_hash(membership), "training": sha256(table_hash(training))}


def apply_frozen(values: DataFrame, frozen: dict, allow_training: bool = False) -> DataFrame:
    """(region, mean, n) of new values; the training values and a changed membership are refused."""
    if table_hash(frozen["membership"]) != frozen["seal"]:
        raise ValueError("the frozen membership has changed")
    if not allow_training and sha256(table_hash(values)) == frozen["training"]:
        raise ValueError("these are the values the regions were found on")
    return values.join(frozen["membership"], "ord").groupBy("region").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


# --- flat maps


def flatten(faces: DataFrame, n: int, rounds: int = 5000, tolerance: float = 1e-12) -> pd.DataFrame:
    """(ord, x, y): a harmonic map to the unit circle; every inner vertex is the mean of its neighbours."""
    t = collected(faces)[["v1", "v2", "v3"]].to_numpy()
    sides = np.sort(np.concatenate([t[:, [0, 1]], t[:, [1, 2]], t[:, [0, 2]]]), axis=1)
    pairs, used = np.unique(sides, axis=0, return_counts=True)
    rim: dict[int, list[int]] = {}
    for a, b in pairs[used == 1]:
        rim.setdefault(int(a), []).append(int(b))
        rim.setdefault(int(b), []).append(int(a))
    if not rim:
        raise ValueError("a closed surface has no boundary to flatten to")
    loop = [min(rim)]
    while len(loop) < len(rim):
        loop.append(next(v for v in sorted(rim[loop[-1]]) if len(loop) < 2 or v != loop[-2]))
    at = np.zeros((n, 2))
    angle = 2 * np.pi * np.arange(len(loop)) / len(loop)
    at[loop] = np.column_stack([np.cos(angle), np.sin(angle)])
    free = np.ones(n, dtype=bool)
    free[loop] = False
    both = np.concatenate([pairs, pairs[:, ::-1]])
    degree = np.bincount(both[:, 0], minlength=n)[:, None]
    # conjugate gradients on the inner vertices
    def apply(x: np.ndarray) -> np.ndarray:
        y = np.where(free[:, None], x, 0)
        return np.where(free[:, None], degree * y - np.stack([np.bincount(both[:, 0], y[both[:, 1], c], n) for c in (0, 1)], axis=1), 0)

    right = np.where(free[:, None], np.stack([np.bincount(both[:, 0], np.where(free, 0, at[:, c])[both[:, 1]], n) for c in (0, 1)], axis=1), 0)
    x, r = np.zeros((n, 2)), right.copy()
    p, rr = r.copy(), (r * r).sum(0)
    for _ in range(rounds):
        if (rr <= tolerance**2).all():
            break
        ap = apply(p)
        alpha = rr / np.maximum((p * ap).sum(0), 1e-300)
        x, r = x + alpha * p, r - alpha * ap
        new = (r * r).sum(0)
        p, rr = r + new / np.maximum(rr, 1e-300) * p, new
    at[free] = x[free]
    return pd.DataFrame({"ord": np.arange(n), "x": at[:, 0], "y": at[:, 1]})


def view(elements: DataFrame, method: str = "orthographic", plane: str = "xy") -> DataFrame:
    """(ord, x, y) of an orthographic, principal-axes or spherical view."""
    if method == "orthographic":
        return elements.select("ord", F.col(plane[0]).alias("x"), F.col(plane[1]).alias("y"))
    if method == "spherical":
        r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
        return elements.select("ord", F.atan2("y", "x").alias("x"), F.asin(F.col("z") / r).alias("y"))
    s = elements.agg(*[F.avg(c).alias(c) for c in "xyz"], *[F.covar_pop(a, b).alias(a + b) for a in "xyz" for b in "xyz"]).first()
    u = np.linalg.eigh(np.array([[s[a + b] for b in "xyz"] for a in "xyz"]))[1][:, ::-1][:, :2]
    u = u * np.sign(u[np.abs(u).argmax(0), [0, 1]])
    axis = lambda k: sum((float(u[m, k]) * (F.col(c) - s[c]) for m, c in enumerate("xyz")), F.lit(0.0))
    return elements.select("ord", axis(0).alias("x"), axis(1).alias("y"))


def map_faces(faces: DataFrame, values: DataFrame, categorical: bool = False, labels: DataFrame | None = None, limits: tuple[float, float] | None = None) -> DataFrame:
    """(face_id, value, colour, boundary): a face's mean of finite corners or majority, 1 + floor(255 t), and whether its corners' labels differ."""
    met = faces
    for v in ("v1", "v2", "v3"):
        met = met.join(values.select(F.col("ord").alias(v), F.when(~F.isnan("value"), F.col("value")).alias(f"x{v}")), v, "left")
        if labels is not None:
            met = met.join(labels.select(F.col("ord").alias(v), F.coalesce("label", F.lit("")).alias(f"l{v}")), v, "left")
    a, b, c = (F.col(f"xv{k}") for k in (1, 2, 3))
    if categorical:
        value = F.when((a == b) | (a == c), a).when(b == c, b).otherwise(F.least(a, b, c))
    else:
        own = F.array_compact(F.array(a, b, c))
        value = F.try_divide(F.aggregate(own, F.lit(0.0), lambda s, x: s + x), F.size(own))
    met = met.withColumn("value", value)
    low, high = limits or met.agg(F.min("value"), F.max("value")).first()
    t = F.lit(0.0) if high == low else F.least(F.greatest((F.col("value") - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    edge = (F.col("lv1") != F.col("lv2")) | (F.col("lv2") != F.col("lv3")) if labels is not None else F.lit(False)
    return met.select("face_id", "value", (1 + F.floor(255 * t)).cast("int").alias("colour"), edge.alias("boundary"))


def outline(faces: DataFrame) -> DataFrame:
    """(i, j): edges of one face only."""
    pairs = faces.select(F.explode(F.array(*[F.struct(F.least(a, b).alias("i"), F.greatest(a, b).alias("j")) for a, b in (("v1", "v2"), ("v2", "v3"), ("v1", "v3"))])).alias("e"))
    return pairs.groupBy("e.i", "e.j").count().where("count = 1").select("i", "j")


def layout(maps: dict[str, DataFrame], shared: bool = False, columns: int | None = None) -> DataFrame:
    """(panel, row, col, low, high): where each map goes and its limits, common ones if shared."""
    columns = columns or math.ceil(math.sqrt(len(maps)))
    rows = [(k, n // columns, n % columns, *m.agg(F.min("value"), F.max("value")).first()) for n, (k, m) in enumerate(maps.items())]
    if shared:
        low, high = min(r[3] for r in rows), max(r[4] for r in rows)
        rows = [(*r[:3], low, high) for r in rows]
    return next(iter(maps.values())).sparkSession.createDataFrame(rows, "panel string, row int, col int, low double, high double")
