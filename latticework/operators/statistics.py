"""Spatial autocorrelation, variograms, and aggregates that merge.

Observed statistics are grouped aggregates over a join of values with weighted
edges. Permutation nulls send the sparse weights to every task once, after their
number is checked, and spread draws over tasks; each draw has its own seed, so
the result does not depend on the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions import numeric
from latticework.model import Dataset, ranked
from latticework.storage import collected

from .graph import csr, dot, shells
from .reach import binned_gaps
from .topology import styled, within

#: Draws at most; pairs of a variogram without a largest distance.
MOST_DRAWS, MOST_PAIRS = 99_999, 1_000_000


@dataclass(frozen=True)
class Permutations:
    """How many draws, with which seed, and how p-values are found and adjusted."""

    draws: int = 999
    seed: int | None = 0
    alternative: str = "two.sided"
    adjust: str = "none"

    def __post_init__(self):
        if not 0 <= self.draws <= MOST_DRAWS:
            raise ValueError(f"between 0 and {MOST_DRAWS} draws")


def retained(values: DataFrame, edges: DataFrame, missing: str = "fail", style: str = "W") -> tuple[DataFrame, DataFrame]:
    """Finite values, and weights among them: rows that are left out take their edges along and the rest is styled again."""
    good = values.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    if missing == "fail":
        if values.join(good.select("ord"), "ord", "left_anti").take(1):
            raise ValueError("missing or non-finite values; omit them explicitly")
        return good, edges
    kept = edges.join(good.select(F.col("ord").alias("i")), "i", "left_semi").join(good.select(F.col("ord").alias("j")), "j", "left_semi")
    return good, styled(kept.select("i", "j", "w_raw"), style)


def centred(values: DataFrame) -> DataFrame:
    """(ord, value, z, n, m2): deviations, with the count and the sum of squares as columns."""
    stats = values.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("*")).alias("m2"))
    return values.join(F.broadcast(stats), F.lit(True)).select("ord", "value", (F.col("value") - F.col("mean")).alias("z"), "n", "m2")


def _ends(edges: DataFrame, values: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    met = edges.select("i", "j", "w")
    for end in "ij":
        met = met.join(values.select(F.col("ord").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)
    return met


def lag(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, lag): the weighted sum over neighbours, 0 without any."""
    sums = edges.join(values.select(F.col("ord").alias("j"), "value"), "j").groupBy(F.col("i").alias("ord")).agg(F.sum(F.col("w") * F.col("value")).alias("lag"))
    return values.select("ord").join(sums, "ord", "left").fillna(0.0, ["lag"])


def moran(values: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: statistic n/S0 z'Wz/z'z, expected -1/(n-1), n."""
    z = centred(values)
    cross = _ends(edges, z, ("z",)).agg(F.sum(F.col("w") * F.col("z_i") * F.col("z_j")).alias("top"), F.sum("w").alias("s0"))
    stats = values.agg(F.count("*").alias("n"), (F.var_pop("value") * F.count("*")).alias("m2"))
    return cross.join(F.broadcast(stats), F.lit(True)).select((F.col("n") / F.col("s0") * F.col("top") / F.col("m2")).alias("statistic"), (-1.0 / (F.col("n") - 1)).alias("expected"), "n")


def geary(values: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: statistic (n-1)/(2 S0) sum w (xi-xj)^2 / z'z, expected 1, n."""
    cross = _ends(edges, values, ("value",)).agg(F.sum(F.col("w") * (F.col("value_i") - F.col("value_j")) ** 2).alias("top"), F.sum("w").alias("s0"))
    stats = values.agg(F.count("*").alias("n"), (F.var_pop("value") * F.count("*")).alias("m2"))
    return cross.join(F.broadcast(stats), F.lit(True)).select(((F.col("n") - 1) / (2 * F.col("s0")) * F.col("top") / F.col("m2")).alias("statistic"), F.lit(1.0).alias("expected"), "n")


def local_moran(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, statistic, z, lag, quadrant)."""
    z = centred(values)
    lags = lag(z.select("ord", F.col("z").alias("value")), edges)
    quadrant = F.when((F.col("z") >= 0) & (F.col("lag") >= 0), "high-high").when((F.col("z") < 0) & (F.col("lag") < 0), "low-low").when(F.col("z") >= 0, "high-low").otherwise("low-high")
    return z.join(lags, "ord").select("ord", (F.col("z") * F.col("lag") / (F.col("m2") / F.col("n"))).alias("statistic"), "z", "lag", quadrant.alias("quadrant"))


def getis_ord(values: DataFrame, edges: DataFrame, star: bool = True, style: str = "B") -> DataFrame:
    """(ord, statistic): Gi* with every element its own neighbour, or Gi without; standardised by population moments."""
    raw = edges.select("i", "j", "w_raw")
    if star:
        raw = raw.where("i <> j").unionByName(values.select(F.col("ord").alias("i"), F.col("ord").alias("j"), F.lit(1.0).alias("w_raw")))
    own = styled(raw, style)
    met = own.join(values.select(F.col("ord").alias("j"), "value"), "j").groupBy(F.col("i").alias("ord")).agg(F.sum(F.col("w") * F.col("value")).alias("top"), F.sum("w").alias("sw"), F.sum(F.col("w") ** 2).alias("sw2"))
    stats = values.agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("s2"))
    all_ = values.join(met, "ord", "left").fillna(0.0, ["top", "sw", "sw2"]).join(F.broadcast(stats), F.lit(True))
    m = F.col("n") if star else F.col("n") - 1
    s = F.col("s") if star else F.col("s") - F.col("value")
    s2 = F.col("s2") if star else F.col("s2") - F.col("value") ** 2
    mean = s / m
    spread = F.sqrt(F.greatest(s2 / m - mean**2, F.lit(0.0)))
    below = spread * F.sqrt((m * F.col("sw2") - F.col("sw") ** 2) / (m - 1))
    return all_.select("ord", F.try_divide(F.col("top") - mean * F.col("sw"), below).alias("statistic"))


def correlogram(values: DataFrame, edges: DataFrame, lags: int = 10) -> DataFrame:
    """(order, statistic, pairs): Moran among pairs at exactly each number of steps, row-standardised."""
    shell = shells(edges, lags)
    counts = shell.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("order", "i")))
    met = counts
    z = centred(values)
    for end in "ij":
        met = met.join(z.select(F.col("ord").alias(end), F.col("z").alias(f"z_{end}")), end)
    stats = values.agg(F.count("*").alias("n"), (F.var_pop("value") * F.count("*")).alias("m2"))
    sums = met.groupBy("order").agg(F.sum(F.col("w") * F.col("z_i") * F.col("z_j")).alias("top"), F.sum("w").alias("s0"), F.count("*").alias("pairs"))
    return sums.join(F.broadcast(stats), F.lit(True)).select("order", (F.col("n") / F.col("s0") * F.col("top") / F.col("m2")).alias("statistic"), "pairs")


def correlogram_test(values: DataFrame, edges: DataFrame, lags: int = 10, control: Permutations = Permutations(), missing: str = "fail") -> DataFrame:  # noqa: B008
    """``correlogram`` with expected, p_value and p_adjusted (over the orders, by the control's method): values are shuffled over the elements.

    With ``missing`` = omit, elements without a value are left out before the
    steps are counted. The shells are sent to the tasks, their number checked.
    """
    own, kept = retained(values, edges, missing, "W")
    shell = shells(kept, lags).withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("order", "i")))
    order = ranked(own.withColumnRenamed("ord", "old"), "old")
    new = order.select("old", F.col("ord").alias("new"))
    moved = shell.join(new.select(F.col("old").alias("i"), F.col("new").alias("ni")), "i").join(new.select(F.col("old").alias("j"), F.col("new").alias("nj")), "j").select("order", F.col("ni").alias("i"), F.col("nj").alias("j"), "w")
    v = collected(order.orderBy("ord").select("value"))["value"].to_numpy()
    counted = sorted((r["order"], r["n"]) for r in moved.groupBy("order").agg(F.count("*").alias("n")).collect())
    shells_ = [csr(moved.where(F.col("order") == o), len(v)) for o, _ in counted]
    spark = values.sparkSession
    sent = spark.sparkContext.broadcast((v, shells_))

    def all_(x: np.ndarray, own: list[tuple]) -> list[float]:
        z = x - x.mean()
        return [float(len(x) / w[2].sum() * (z @ dot(w, z)) / (z * z).sum()) for w in own]

    found = draws(spark, control.draws, control.seed, lambda d, rng: list(enumerate(all_(rng.permutation(sent.value[0]), sent.value[1]))), "place int, statistic double").toPandas()
    observed, expected = all_(v, shells_), -1 / (len(v) - 1)
    null = [found.loc[found["place"] == k, "statistic"].to_numpy() for k in range(len(observed))]
    p = np.array([numeric.permutation_p(o, n, expected, control.alternative) for o, n in zip(observed, null, strict=True)])
    if control.adjust == "maxT":
        most = np.max([np.abs(n - expected) for n in null], axis=0)
        adjusted = [(int((most >= abs(o - expected)).sum()) + 1) / (len(most) + 1) for o in observed]
    else:
        adjusted = p if control.adjust == "none" else numeric.adjust(p, control.adjust)
    rows = [(o, s, n, expected, float(a), float(b)) for (o, n), s, a, b in zip(counted, observed, p, adjusted, strict=True)]
    return spark.createDataFrame(rows, "order int, statistic double, pairs long, expected double, p_value double, p_adjusted double")


def variogram_pairs(values: DataFrame, at: DataFrame, most: float, dims: str = "xyz") -> DataFrame:
    """(distance, gamma) of pairs i < j within ``most``: a range join."""
    near = within(at, at, most, dims).where("i < j")
    for end in "ij":
        near = near.join(values.select(F.col("ord").alias(end), F.col("value").alias(f"v_{end}")), end)
    return near.select("distance", (0.5 * (F.col("v_i") - F.col("v_j")) ** 2).alias("gamma"))


def binned_within(values: DataFrame, at: DataFrame, most: float, breaks: int | list[float] = 10, dims: str = "xyz") -> DataFrame:
    """``binned`` of ``variogram_pairs``, without a row for any pair: tasks send sums of bins."""
    edges = [float(most) * k / breaks for k in range(breaks + 1)] if isinstance(breaks, int) else list(breaks)
    return binned_gaps(values, at, ["value"], most, edges, dims, [(0, 0)]).select("bin", "distance", "gamma", "n")


def binned(pairs: DataFrame, breaks: int | list[float] = 10, most: float | None = None) -> DataFrame:
    """(bin, distance, gamma, n): equal bins from 0, closed on the right, the first with 0; mean distance inside a bin; no empty bins."""
    if isinstance(breaks, int):
        top = most if most is not None else pairs.agg(F.max("distance")).first()[0]
        edges = [float(top) * k / breaks for k in range(breaks + 1)]
    else:
        edges = list(breaks)
    bin_ = sum((F.when(F.col("distance") > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(1))
    inside = pairs.where((F.col("distance") >= edges[0]) & (F.col("distance") <= edges[-1]))
    return inside.groupBy(bin_.alias("bin")).agg(F.avg("distance").alias("distance"), F.avg("gamma").alias("gamma"), F.count("*").alias("n"))


def variogram(x: Dataset, layer: int | str = 0, breaks: int | list[float] = 10, most: float | None = None, pairs: int = MOST_PAIRS) -> DataFrame:
    """Binned semivariances: of all pairs, whose number is checked, or of those within ``most``, which is a range join."""
    dims = "xyz" if x.elements.where("z is not null").take(1) else "xy"
    at = x.elements.select("ord", *dims)
    reach = most
    if most is None:
        n, *ends = at.agg(F.count("*"), *[F.max(c) - F.min(c) for c in dims]).first()
        if (wanted := n * (n - 1) // 2) > pairs:
            raise ValueError(f"{wanted} pairs; the limit is {pairs}: give a largest distance")
        reach = max(sum(v * v for v in ends if v is not None) ** 0.5, 1e-300)
    # without a largest distance the last bin ends at the farthest pair, which only the pairs tell
    return binned(variogram_pairs(x.layer(layer), at, reach, dims), breaks) if most is None else binned_within(x.layer(layer), at, most, breaks, dims)


def draws(spark, n: int, seed: int | None, run: Callable[[int, np.random.Generator], list[tuple]], schema: str, parts: int | None = None) -> DataFrame:  # noqa: ANN001
    """Rows (draw, ...) of ``run(draw, generator)``, the draws spread over tasks."""
    seeds = spark.createDataFrame(list(enumerate(numeric.streams(seed, n))), "draw long, seed long")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            rows = [(d, *r) for d, s in zip(batch["draw"], batch["seed"], strict=True) for r in run(int(d), np.random.default_rng(int(s)))]
            yield pd.DataFrame(rows, columns=["draw", *names])

    return seeds.repartition(parts or min(max(n, 1), spark.sparkContext.defaultParallelism * 2)).mapInPandas(each, f"draw long, {schema}")


def _dense(values: DataFrame, edges: DataFrame) -> tuple[np.ndarray, tuple, DataFrame]:
    """Values and weights with closed-up ordinals, for tasks: the number of edges is checked."""
    order = ranked(values.withColumnRenamed("ord", "old"), "old")
    new = order.select("old", F.col("ord").alias("new"))
    moved = edges.join(new.select(F.col("old").alias("i"), F.col("new").alias("ni")), "i").join(new.select(F.col("old").alias("j"), F.col("new").alias("nj")), "j").select(F.col("ni").alias("i"), F.col("nj").alias("j"), "w")
    v = collected(order.orderBy("ord").select("value"))["value"].to_numpy()
    return v, csr(moved, len(v)), new


def permutation_test(values: DataFrame, edges: DataFrame, statistic: str = "moran", control: Permutations = Permutations()) -> DataFrame:  # noqa: B008
    """One row: statistic, expected, p_value, draws; all values are shuffled over the elements."""
    v, w, _ = _dense(values, edges)
    spark = values.sparkSession
    sent = spark.sparkContext.broadcast((v, w))

    def one(x: np.ndarray, w: tuple) -> float:
        z = x - x.mean()
        s0, m2 = w[2].sum(), (z * z).sum()
        if statistic == "moran":
            return len(x) / s0 * (z @ dot(w, z)) / m2
        row = np.repeat(np.arange(len(x)), np.diff(w[0]))
        return (len(x) - 1) / (2 * s0) * (w[2] * (x[row] - x[w[1]]) ** 2).sum() / m2

    null = draws(spark, control.draws, control.seed, lambda d, rng: [(float(one(rng.permutation(sent.value[0]), sent.value[1])),)], "statistic double").toPandas()["statistic"].to_numpy()
    expected = -1 / (len(v) - 1) if statistic == "moran" else 1.0
    observed = float(one(v, w))
    p = numeric.permutation_p(observed, null, expected, control.alternative)
    return spark.createDataFrame([(observed, expected, float(p), control.draws)], "statistic double, expected double, p_value double, draws int")


def local_permutation_test(values: DataFrame, edges: DataFrame, control: Permutations = Permutations()) -> DataFrame:  # noqa: B008
    """local_moran with p_value (and p_adjusted): neighbours drawn from the other elements, element by element, in blocks."""
    v, w, new = _dense(values, edges)
    spark = values.sparkSession
    sent = spark.sparkContext.broadcast((v, w, control))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, (starts, _, weight), own = sent.value
        z = v - v.mean()
        m2, n = (z * z).mean(), len(v)
        for part in parts:
            out = []
            for i in part["new"]:
                k, ww = starts[i + 1] - starts[i], weight[starts[i] : starts[i + 1]]
                rng = np.random.default_rng([own.seed or 0, int(i)])
                near = sent.value[1][1][starts[i] : starts[i + 1]]
                observed = z[i] * (ww @ z[near]) / m2
                if not k:
                    out.append((int(i), math.nan))
                    continue
                # k of the n - 1 others without replacement, for all draws at once if few
                pick = np.array([rng.choice(n - 1, size=k, replace=False) for _ in range(own.draws)])
                pick += pick >= i
                null = z[i] * (z[pick] @ ww) / m2
                out.append((int(i), numeric.permutation_p(observed, null, -float(ww.sum()) / (n - 1), own.alternative)))
            yield pd.DataFrame(out, columns=["new", "p_value"])

    # the ordinals come from one small table, so they are dealt out: else one task has them all
    p = new.select("new").repartition(4 * spark.sparkContext.defaultParallelism).mapInPandas(run, "new long, p_value double").join(new, "new").select(F.col("old").alias("ord"), "p_value")
    out = local_moran(values, edges).join(p, "ord")
    if control.adjust == "none":
        return out.withColumn("p_adjusted", F.col("p_value"))
    if control.adjust == "BH":
        return out.join(benjamini_hochberg(out.select(F.col("ord").alias("_of"), F.when(~F.isnan("p_value"), F.col("p_value")).alias("p_value"))).select(F.col("_of").alias("ord"), "p_adjusted"), "ord", "left")
    table = collected(out.select("ord", "p_value"))
    table["p_adjusted"] = numeric.adjust(table["p_value"].to_numpy(), control.adjust)
    return out.join(spark.createDataFrame(table[["ord", "p_adjusted"]]), "ord")


def benjamini_hochberg(tests: DataFrame, p: str = "p_value") -> DataFrame:
    """Add p_adjusted to any number of rows without collecting them: ranks by range, then a running minimum of part minima."""
    own = ranked(tests.where(F.col(p).isNotNull()), p)
    n = own.count()
    step = own.withColumn("_q", F.least(F.lit(1.0), F.col(p) * n / (F.col("ord") + 1)))
    size = 100_000
    step = step.withColumn("_block", F.floor(F.col("ord") / size))
    later = step.groupBy("_block").agg(F.min("_q").alias("_m")).withColumn("_later", F.min("_m").over(Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1))).select("_block", "_later")
    run = F.min("_q").over(Window.partitionBy("_block").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0))
    return step.join(F.broadcast(later), "_block").withColumn("p_adjusted", F.least(run, F.coalesce("_later", F.lit(1.0)))).drop("_q", "_block", "_later", "ord")


def spectral_null(values: DataFrame, edges: DataFrame, n: int = 999, seed: int = 0, most: int = 2000) -> DataFrame:
    """(draw, ord, value): surrogates with the spatial spectrum kept, by random signs of centred eigenvectors."""
    v, (starts, columns, weight), new = _dense(values, edges)
    if len(v) > most:
        raise ValueError(f"{len(v)} elements; a dense spectrum takes {most}")
    dense = np.zeros((len(v), len(v)))
    dense[np.repeat(np.arange(len(v)), np.diff(starts)), columns] = weight
    # a basis of what is orthogonal to the constant
    inside = np.linalg.qr(np.column_stack([np.ones(len(v)), np.eye(len(v))[:, 1:]]))[0][:, 1:]
    vectors = inside @ np.linalg.eigh(inside.T @ (dense + dense.T) @ inside / 2)[1]
    loads = vectors.T @ v
    sent = values.sparkSession.sparkContext.broadcast((vectors, loads, v.mean(), new.orderBy("new").toPandas()["old"].tolist()))

    def run(_: int, rng: np.random.Generator) -> list[tuple]:
        vectors, loads, mean, old = sent.value
        made = vectors @ (loads * rng.choice([-1.0, 1.0], size=len(loads))) + mean
        return list(zip(old, map(float, made), strict=True))

    return draws(values.sparkSession, n, seed, run, "ord long, value double")


def spin_null(values: DataFrame, sphere: DataFrame, n: int = 999, seed: int = 0, strata: str | None = None) -> DataFrame:
    """(draw, ord, value): values reassigned to the nearest element of a randomly turned sphere (ord, x, y, z), inside strata."""
    table = collected(values.join(sphere, "ord").orderBy("ord"))
    at = table[["x", "y", "z"]].to_numpy()
    at = at / np.linalg.norm(at, axis=1, keepdims=True)
    group = table[strata].to_numpy() if strata else np.zeros(len(table))
    sent = values.sparkSession.sparkContext.broadcast((table["ord"].tolist(), table["value"].to_numpy(), at, group))

    def run(_: int, rng: np.random.Generator) -> list[tuple]:
        ords, v, at, group = sent.value
        q, r = np.linalg.qr(rng.normal(size=(3, 3)))
        q *= np.sign(np.diag(r))
        if np.linalg.det(q) < 0:
            q[:, 0] *= -1
        out = np.empty(len(v))
        for g in np.unique(group):
            own = np.flatnonzero(group == g)
            turned = at[own] @ q.T
            for block in range(0, len(own), 1024):
                out[own[block : block + 1024]] = v[own[np.argmax(at[own[block : block + 1024]] @ turned.T, axis=1)]]
        return list(zip(ords, map(float, out), strict=True))

    return draws(values.sparkSession, n, seed, run, "ord long, value double")


def summary(values: DataFrame) -> DataFrame:
    """(layer_ord, n, missing, mean, variance, min, max): partial aggregates merge, so one pass whatever the size."""
    gone = F.col("value").isNull() | F.isnan("value")
    v = F.when(~gone, F.col("value"))
    return values.groupBy("layer_ord").agg(F.count(v).alias("n"), F.count_if(gone).alias("missing"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), F.min(v).alias("min"), F.max(v).alias("max"))


def wide(values: DataFrame, layers: list[int]) -> DataFrame:
    """(ord, v0, v1, ...) of chosen layers."""
    found = values.where(F.col("layer_ord").isin(layers)).groupBy("ord").pivot("layer_ord", layers).agg(F.first("value"))
    return found.select("ord", *[F.col(f"`{k}`").alias(f"v{n}") for n, k in enumerate(layers)])


def covariance(values: DataFrame, layers: list[int]) -> DataFrame:
    """(a, b, covariance) of layers, one pass over the elements."""
    table = wide(values, layers)
    pairs = [(a, b) for a in range(len(layers)) for b in range(a, len(layers))]
    row = table.agg(*[F.covar_samp(f"v{a}", f"v{b}").alias(f"c{a}_{b}") for a, b in pairs])
    each = F.array(*[F.struct(F.lit(layers[a]).alias("a"), F.lit(layers[b]).alias("b"), F.col(f"c{a}_{b}").alias("covariance")) for a, b in pairs])
    return row.select(F.inline(each))


def regression(table: DataFrame, response: str, predictors: list[str]) -> DataFrame:
    """(term, estimate, std_error, t, p_value): least squares from cross products summed in one pass."""
    terms = ["intercept", *predictors]
    col = lambda t: F.lit(1.0) if t == "intercept" else F.col(t)
    all_ = [*terms, response]
    sums = table.agg(F.count("*").alias("n"), *[F.sum(col(a) * col(b)).alias(f"s{i}_{j}") for i, a in enumerate(all_) for j, b in enumerate(all_) if i <= j]).first()
    p = len(terms)
    full = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)], dtype=float)
    inverse = np.linalg.pinv(full[:p, :p])
    beta = inverse @ full[:p, p]
    df = sums["n"] - p
    s2 = max(full[p, p] - beta @ full[:p, p], 0.0) / df if df > 0 else math.nan
    rows = []
    for t, b, v in zip(terms, beta, np.diag(inverse), strict=True):
        se = math.sqrt(s2 * v) if s2 == s2 else math.nan
        rows.append((t, float(b), se, float(b / se) if se else math.nan, numeric.t_two_sided(float(b / se), df) if se else math.nan))
    return table.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, t double, p_value double")


def check_budget(df: DataFrame, rows: int | None = None, name: str = "rows") -> DataFrame:
    """Refuse a table of more than ``rows`` rows, before anything is made of it."""
    if rows is not None and (n := df.count()) > rows:
        raise MemoryError(f"{n} {name}; the budget is {rows}")
    return df
