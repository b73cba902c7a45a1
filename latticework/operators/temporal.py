"""Time axes, weights in time and space-time, and per-element series.

Layers are the points of time; ``axis`` rows are (time_ord, time and perhaps
interval_start, interval_end). Space-time weights are never multiplied out:
their lag is one pass over the spatial and one over the temporal edges.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.model import Dataset, sha256
from latticework.storage import collected

from .statistics import Permutations, _dense, binned, draws
from .topology import styled

UNITS = ("millisecond", "second", "minute", "hour", "day", "week", "month", "year", "frame")
#: Meanings of a value in time, and the reductions each allows.
SEMANTICS = {"instantaneous": ("mean", "linear", "integral"), "interval_mean": ("mean", "linear", "integral"), "interval_total": ("sum", "linear"), "rate": ("mean", "linear", "integral"), "cumulative": ("linear",)}


@dataclass(frozen=True)
class TimeAxis:
    time: tuple[float, ...]
    unit: str = "second"
    start: tuple[float, ...] | None = None
    end: tuple[float, ...] | None = None

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, float(t), *((self.start[n], self.end[n]) if self.start else (None, None))) for n, t in enumerate(self.time)]
        return spark.createDataFrame(rows, "time_ord int, time double, interval_start double, interval_end double")

    def hash(self) -> str:
        return sha256(vars(self))


def time_axis(time: list[float] | None = None, start: float = 0.0, step: float = 1.0, n: int | None = None, unit: str = "second", interval_start: list[float] | None = None, interval_end: list[float] | None = None, allow_overlap: bool = False, tolerance: float = 1e-10) -> TimeAxis:
    """A regular or given axis of increasing times, as instants or intervals."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}")
    own = [start + step * k for k in range(n or 0)] if time is None else list(map(float, time))
    if any(b - a <= tolerance for a, b in zip(own, own[1:], strict=False)):
        raise ValueError("times must increase")
    if (interval_start is None) != (interval_end is None):
        raise ValueError("intervals have two ends")
    if interval_start is not None:
        if any(e <= s for s, e in zip(interval_start, interval_end, strict=True)):
            raise ValueError("intervals must have a length")
        if not allow_overlap and any(s < e - tolerance for s, e in zip(interval_start[1:], interval_end, strict=False)):
            raise ValueError("intervals overlap")
        return TimeAxis(tuple(own), unit, tuple(interval_start), tuple(interval_end))
    return TimeAxis(tuple(own), unit)


def set_time_axis(x: Dataset, axis: TimeAxis, semantics: str = "instantaneous") -> Dataset:
    if semantics not in SEMANTICS:
        raise ValueError(f"unknown temporal semantics {semantics!r}")
    if x.layers.count() != len(axis.time):
        raise ValueError("the axis does not fit the layers")
    return replace(x, time_axis=axis, measures=x.measures.withColumn("temporal_semantics", F.lit(semantics))).noted("set_time_axis", axis=axis.hash())


def series(x: Dataset) -> DataFrame:
    """(ord, time_ord, time, value)."""
    return x.values.join(F.broadcast(x.time_axis.table(x.spark).select(F.col("time_ord").alias("layer_ord"), "time")), "layer_ord").select("ord", F.col("layer_ord").alias("time_ord"), "time", "value")


def time_slice(x: Dataset, index: list[int] | None = None, between: tuple[float, float] | None = None) -> Dataset:
    """Layers by place or by an inclusive range of time."""
    from latticework.model import subset

    a = x.time_axis
    chosen = index if index is not None else [n for n, t in enumerate(a.time) if between[0] <= t <= between[1]]
    cut_ = lambda v: tuple(v[n] for n in chosen) if v else None
    return replace(subset(x, layers=chosen), time_axis=TimeAxis(cut_(a.time), a.unit, cut_(a.start), cut_(a.end)))


def temporal_weights(axis: TimeAxis, spark: SparkSession, method: str = "adjacent", lag: int = 1, threshold: float | None = None, directed: bool = False, style: str = "W") -> DataFrame:
    """(i, j, w_raw, w) between points of time: neighbours, an index lag, or times within a threshold."""
    n = len(axis.time)
    step = 1 if method == "adjacent" else lag
    if method == "distance":
        pairs = [(a, b) for a in range(n) for b in range(n) if a != b and abs(axis.time[a] - axis.time[b]) <= threshold]
    else:
        pairs = [(a, a - step) for a in range(step, n)] + [(a, a + step) for a in range(n - step)]
    if directed:
        pairs = [(a, b) for a, b in pairs if b < a]
    return styled(spark.createDataFrame([(a, b, 1.0) for a, b in sorted(pairs)], "i long, j long, w_raw double"), style)


@dataclass(frozen=True)
class SpaceTime:
    """Spatial and temporal edges (i, j, w) joined as a Kronecker sum (shares scale and 1 - scale) or product."""

    spatial: DataFrame
    temporal: DataFrame
    combination: str = "sum"
    scale: float = 0.5

    def __post_init__(self):
        if self.combination not in ("sum", "product") or not 0 <= self.scale <= 1:
            raise ValueError("a sum with a share from 0 to 1, or a product")


def _along(v: DataFrame, edges: DataFrame, axis: str) -> DataFrame:
    """Weighted sums of (ord, time_ord, value) over neighbours in space (ord) or time (time_ord)."""
    other = "time_ord" if axis == "ord" else "ord"
    met = v.withColumnRenamed(axis, "j").join(F.broadcast(edges.select("i", "j", "w")) if axis == "time_ord" else edges.select("i", "j", "w"), "j")
    return met.groupBy(F.col("i").alias(axis), other).agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def lagged(v: DataFrame, w: SpaceTime) -> DataFrame:
    """(ord, time_ord, lag) of v (ord, time_ord, value), 0 without neighbours."""
    space = _along(v, w.spatial, "ord")
    if w.combination == "product":
        found = _along(space, w.temporal, "time_ord")
    else:
        both = space.select("ord", "time_ord", (w.scale * F.col("value")).alias("value")).unionByName(_along(v, w.temporal, "time_ord").select("ord", "time_ord", ((1 - w.scale) * F.col("value")).alias("value")))
        found = both.groupBy("ord", "time_ord").agg(F.sum("value").alias("value"))
    return v.select("ord", "time_ord").join(found.withColumn("time_ord", F.col("time_ord").cast("int")).withColumnRenamed("value", "lag"), ["ord", "time_ord"], "left").fillna(0.0, ["lag"])


def materialised(w: SpaceTime, elements: DataFrame, n_times: int, most: int = 10_000) -> DataFrame:
    """(i, j, w) on observations ord * n_times + time, for small problems only."""
    n = elements.count()
    if n * n_times > most:
        raise ValueError(f"{n * n_times} observations; the limit is {most}")
    at = lambda o, t: F.col(o) * n_times + F.col(t)
    if w.combination == "product":
        t = w.temporal.select(F.col("i").alias("ti"), F.col("j").alias("tj"), F.col("w").alias("tw"))
        return w.spatial.join(F.broadcast(t), F.lit(True)).select(at("i", "ti").alias("i"), at("j", "tj").alias("j"), (F.col("w") * F.col("tw")).alias("w"))
    times = F.explode(F.sequence(F.lit(0), F.lit(n_times - 1)))
    space = w.spatial.withColumn("t", times).select(at("i", "t").alias("i"), at("j", "t").alias("j"), (w.scale * F.col("w")).alias("w"))
    time = w.temporal.select("i", "j", "w").join(F.broadcast(elements.select("ord")), F.lit(True)).select(at("ord", "i").alias("i"), at("ord", "j").alias("j"), ((1 - w.scale) * F.col("w")).alias("w"))
    return space.unionByName(time).groupBy("i", "j").agg(F.sum("w").alias("w"))


def temporal_moran(v: DataFrame, temporal: DataFrame) -> DataFrame:
    """(ord, statistic): Moran over time of every element's series; null for constant ones."""
    own = Window.partitionBy("ord")
    z = v.withColumn("value", F.col("value") - F.avg("value").over(own))
    lags = _along(z, temporal, "time_ord").withColumnRenamed("value", "lag")
    s0 = temporal.agg(F.sum("w")).first()[0]
    met = z.join(lags.withColumn("time_ord", F.col("time_ord").cast("int")), ["ord", "time_ord"], "left")
    return met.groupBy("ord").agg(F.try_divide(F.count("*") / F.lit(s0) * F.sum(F.col("value") * F.coalesce("lag", F.lit(0.0))), F.sum(F.col("value") ** 2)).alias("statistic"))


def spacetime_moran(v: DataFrame, w: SpaceTime) -> DataFrame:
    """One row (statistic, n) over all observations; S0 in closed form from the two factors."""
    stats = v.agg(F.avg("value").alias("mean"), F.count("*").alias("n"), F.countDistinct("ord").alias("ne"), F.countDistinct("time_ord").alias("nt")).first()
    z = v.withColumn("value", F.col("value") - F.lit(stats["mean"]))
    s = w.spatial.agg(F.sum("w")).first()[0] or 0.0
    t = w.temporal.agg(F.sum("w")).first()[0] or 0.0
    s0 = s * t if w.combination == "product" else w.scale * s * stats["nt"] + (1 - w.scale) * t * stats["ne"]
    met = z.join(lagged(z, w), ["ord", "time_ord"])
    return met.agg((F.count("*") / F.lit(s0) * F.sum(F.col("value") * F.col("lag")) / F.sum(F.col("value") ** 2)).alias("statistic"), F.count("*").alias("n"))


def spacetime_moran_test(v: DataFrame, w: SpaceTime, control: Permutations = Permutations(), null: str = "spatial_profiles") -> DataFrame:  # noqa: B008
    """One row (statistic, p_value): whole series move between elements, or all observations are shuffled."""
    from latticework.functions import numeric

    from .graph import csr, dot

    times = [r[0] for r in v.select("time_ord").distinct().orderBy("time_ord").collect()]
    base = v.groupBy("ord").agg(F.first("value").alias("value"))
    _, spatial, new = _dense(base, w.spatial)
    table = collected(v.join(new.withColumnRenamed("old", "ord"), "ord").select("new", "time_ord", "value")).pivot(index="new", columns="time_ord", values="value").sort_index()[times].to_numpy()
    temporal = csr(w.temporal, len(times))
    sent = v.sparkSession.sparkContext.broadcast((table - table.mean(), spatial, temporal))

    def one(z, spatial, temporal) -> float:  # noqa: ANN001
        first = dot(spatial, z)
        lag = dot(temporal, first.T).T if w.combination == "product" else w.scale * first + (1 - w.scale) * dot(temporal, z.T).T
        return float((z * lag).sum() / (z * z).sum())

    scale, combination = w.scale, w.combination

    def run(_, rng):  # noqa: ANN001, ANN202
        z, spatial, temporal = sent.value
        moved = z[rng.permutation(len(z))] if null == "spatial_profiles" else rng.permutation(z.ravel()).reshape(z.shape)
        first = dot(spatial, moved)
        lag = dot(temporal, first.T).T if combination == "product" else scale * first + (1 - scale) * dot(temporal, moved.T).T
        return [(float((moved * lag).sum() / (moved * moved).sum()),)]

    found = draws(v.sparkSession, control.draws, control.seed, run, "statistic double").toPandas()["statistic"].to_numpy()
    observed = one(*sent.value)
    p = numeric.permutation_p(observed, found, float(found.mean()) if len(found) else 0.0, control.alternative)
    full = spacetime_moran(v, w).first()["statistic"]
    return v.sparkSession.createDataFrame([(full, float(p), control.draws)], "statistic double, p_value double, draws int")


def temporal_variogram(v: DataFrame, breaks: int | list[float] = 10, most: float | None = None) -> DataFrame:
    """Pooled over elements: pairs of times of one element."""
    a = v.select("ord", F.col("time").alias("ta"), F.col("value").alias("va"))
    met = a.join(v.select("ord", F.col("time").alias("tb"), F.col("value").alias("vb")), "ord").where("ta < tb")
    return binned(met.select((F.col("tb") - F.col("ta")).alias("distance"), (0.5 * (F.col("va") - F.col("vb")) ** 2).alias("gamma")), breaks, most)


def spacetime_variogram(v: DataFrame, pairs: DataFrame, spatial_breaks: list[float], temporal_breaks: list[float]) -> DataFrame:
    """(space_bin, time_bin, space, time, gamma, n) from pairs of elements (i, j, distance) and their times."""
    met = pairs.join(v.select(F.col("ord").alias("i"), F.col("time").alias("ta"), F.col("value").alias("va")), "i").join(v.select(F.col("ord").alias("j"), F.col("time").alias("tb"), F.col("value").alias("vb")), "j")
    met = met.withColumn("dt", F.abs(F.col("ta") - F.col("tb")))
    met = met.where((F.col("distance") <= spatial_breaks[-1]) & (F.col("dt") <= temporal_breaks[-1]))
    bin_ = lambda c, e: sum((F.when(F.col(c) > x, 1).otherwise(0) for x in e[1:-1]), F.lit(1))
    return met.groupBy(bin_("distance", spatial_breaks).alias("space_bin"), bin_("dt", temporal_breaks).alias("time_bin")).agg(F.avg("distance").alias("space"), F.avg("dt").alias("time"), F.avg(0.5 * (F.col("va") - F.col("vb")) ** 2).alias("gamma"), F.count("*").alias("n"))


def change(v: DataFrame, before: int, after: int, scale: str = "difference") -> DataFrame:
    """(ord, value): difference, rate per unit of time, or percent (null from 0)."""
    pair = v.where(F.col("time_ord").isin(before, after)).groupBy("ord").agg(*[F.max(F.when(F.col("time_ord") == k, F.col(c))).alias(f"{c}{n}") for n, k in ((0, before), (1, after)) for c in ("value", "time")])
    gap = F.col("value1") - F.col("value0")
    out = {"difference": gap, "rate": gap / (F.col("time1") - F.col("time0")), "percent": F.when(F.col("value0") != 0, 100 * gap / F.col("value0"))}[scale]
    return pair.select("ord", out.alias("value"))


def trend(v: DataFrame) -> DataFrame:
    """(ord, slope, intercept) by least squares over time."""
    return v.groupBy("ord").agg(F.regr_slope("value", "time").alias("slope"), F.regr_intercept("value", "time").alias("intercept"))


def contrast(v: DataFrame, operation: str = "mean", coefficients: list[float] | None = None, semantics: str = "instantaneous", axis: DataFrame | None = None) -> DataFrame:
    """(ord, value): a linear combination, mean, sum or integral, as the meaning of the values in time allows.

    The integral is by the trapezium rule for instants, and by the lengths of the
    intervals in ``axis`` for values over intervals.
    """
    if operation not in SEMANTICS[semantics]:
        raise ValueError(f"{semantics} values have no {operation}")
    if operation == "linear":
        weight = F.element_at(F.array(*[F.lit(float(c)) for c in coefficients]), F.col("time_ord") + 1)
        return v.groupBy("ord").agg(F.sum(F.col("value") * weight).alias("value"))
    if operation in ("mean", "sum"):
        return v.groupBy("ord").agg((F.avg("value") if operation == "mean" else F.sum("value")).alias("value"))
    if semantics == "interval_mean" and axis is not None:
        met = v.join(F.broadcast(axis.select("time_ord", (F.col("interval_end") - F.col("interval_start")).alias("length"))), "time_ord")
        return met.groupBy("ord").agg(F.sum(F.col("value") * F.col("length")).alias("value"))
    order = Window.partitionBy("ord").orderBy("time")
    piece = 0.5 * (F.col("value") + F.lag("value").over(order)) * (F.col("time") - F.lag("time").over(order))
    return v.withColumn("piece", piece).groupBy("ord").agg(F.sum("piece").alias("value"))
