"""Inference that names its support: effects over several maps, with one common null."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions import numeric
from latticework.model import ranked
from latticework.storage import collected

from .statistics import Permutations, draws
from .support import SupportMap, aggregate


def _effect(x: np.ndarray, y: np.ndarray, statistic: str) -> float:
    zx, zy = x - x.mean(), y - y.mean()
    top, below = float(zx @ zy), float(zx @ zx)
    if statistic == "slope":
        return top / below if below else math.nan
    both = math.sqrt(below * float(zy @ zy))
    return top / both if both else math.nan


def region_effects(outcome: DataFrame, predictor: DataFrame, maps: dict[str, SupportMap], statistic: str = "correlation") -> DataFrame:
    """(support, n, effect): correlation or slope over each map's regions, intensive aggregates of (ord, value)."""
    out = None
    for name, m in maps.items():
        pair = [aggregate(v.select("ord", F.lit(0).alias("layer_ord"), "value"), m, "intensive", unmapped="drop").select("target_ord", F.col("value").alias(c)) for v, c in ((outcome, "y"), (predictor, "x"))]
        met = pair[0].join(pair[1], "target_ord")
        effect = F.corr("y", "x") if statistic == "correlation" else F.regr_slope("y", "x")
        row = met.agg(F.lit(name).alias("support"), F.count("*").alias("n"), effect.alias("effect"))
        out = row if out is None else out.unionByName(row)
    return out


def robust_effect(outcome: DataFrame, predictor: DataFrame, maps: dict[str, SupportMap]) -> DataFrame:
    """(support, slope, std_error, p_value, p_adjusted, agree): support-weighted slopes, and whether all have one sign."""
    rows = []
    for name, m in maps.items():
        pair = [aggregate(v.select("ord", F.lit(0).alias("layer_ord"), "value"), m, "intensive", unmapped="drop").select("target_ord", F.col("value").alias(c)) for v, c in ((outcome, "y"), (predictor, "x"))]
        met = pair[0].join(pair[1], "target_ord").join(m.target_support(), "target_ord")
        s = F.col("support")
        t = met.agg(F.count("*").alias("n"), F.sum(s).alias("s"), *[F.sum(s * F.col(a) * F.col(b)).alias(a + b) for a, b in (("x", "x"), ("x", "y"), ("y", "y"))], F.sum(s * F.col("x")).alias("x"), F.sum(s * F.col("y")).alias("y")).first()
        sxx, sxy, syy = t["xx"] - t["x"] ** 2 / t["s"], t["xy"] - t["x"] * t["y"] / t["s"], t["yy"] - t["y"] ** 2 / t["s"]
        slope, df = sxy / sxx, t["n"] - 2
        se = math.sqrt(max(syy - slope * sxy, 0) / df / sxx) if df > 0 else math.nan
        rows.append([name, slope, se, numeric.t_two_sided(slope / se, df) if se else math.nan])
    adjusted = numeric.adjust(np.array([r[3] for r in rows]), "BH")
    agree = len({np.sign(r[1]) for r in rows}) == 1
    return outcome.sparkSession.createDataFrame([(*r, float(a), agree) for r, a in zip(rows, adjusted, strict=True)], "support string, slope double, std_error double, p_value double, p_adjusted double, agree boolean")


def common_test(outcome: DataFrame, predictor: DataFrame, maps: dict[str, SupportMap], statistic: str = "correlation", control: Permutations = Permutations(), null: DataFrame | None = None, adjustment: str = "maxT") -> DataFrame:  # noqa: B008
    """(support, effect, p_value, p_adjusted): one null of the predictor at the source for all supports.

    Without ``null`` (draw, ord, value) from a spatial null model the predictor
    is shuffled. The maps' shares are sent to the tasks that take the draws.
    """
    both = ranked(outcome.select("ord", F.col("value").alias("y")).join(predictor.select("ord", F.col("value").alias("x")), "ord").withColumnRenamed("ord", "old"), "old")
    table = collected(both.orderBy("ord"))
    at = {int(o): k for k, o in enumerate(table["old"])}
    x, y, shares = table["x"].to_numpy(), table["y"].to_numpy(), {}
    for name, m in maps.items():
        t = collected(m.weights.join(m.support, "source_ord"))
        t = t[t["source_ord"].isin(at)]
        rows, target = np.unique(t["target_ord"], return_inverse=True)
        shares[name] = (np.array([at[int(o)] for o in t["source_ord"]]), target, (t["weight"] * t["support"]).to_numpy(), len(rows))

    def over(v: np.ndarray, share: tuple) -> np.ndarray:
        source, target, w, n = share
        return np.bincount(target, w * v[source], n) / np.bincount(target, w, n)

    fixed = {k: over(y, s) for k, s in shares.items()}
    observed = {k: _effect(over(x, s), fixed[k], statistic) for k, s in shares.items()}
    spark = outcome.sparkSession
    sent = spark.sparkContext.broadcast((x, shares, fixed))
    if null is None:
        def run(_: int, rng: np.random.Generator) -> list[tuple]:
            x, shares, fixed = sent.value
            v = rng.permutation(x)
            return [(k, float(_effect(over(v, s), fixed[k], statistic))) for k, s in shares.items()]

        found = draws(spark, control.draws, control.seed, run, "support string, effect double")
    else:
        def each(part):  # noqa: ANN001, ANN202
            import pandas as pd

            _, shares, fixed = sent.value
            v = np.zeros(len(at))
            v[[at[int(o)] for o in part["ord"]]] = part["value"]
            return pd.DataFrame([(int(part["draw"].iloc[0]), k, _effect(over(v, s), fixed[k], statistic)) for k, s in shares.items()], columns=["draw", "support", "effect"])

        found = null.groupBy("draw").applyInPandas(each, "draw long, support string, effect double")
    wide = found.groupBy("draw").pivot("support", list(maps)).agg(F.first("effect")).toPandas()
    rows, largest = [], np.abs(wide[list(maps)].to_numpy()).max(axis=1)
    for k in maps:
        p = numeric.permutation_p(observed[k], wide[k].to_numpy(), 0.0, control.alternative)
        rows.append([k, observed[k], p, (int((largest >= abs(observed[k])).sum()) + 1) / (len(largest) + 1)])
    if adjustment != "maxT":
        for r, a in zip(rows, numeric.adjust(np.array([r[2] for r in rows]), adjustment), strict=True):
            r[3] = float(a)
    return spark.createDataFrame([tuple(map(lambda v: v if isinstance(v, str) else float(v), r)) for r in rows], "support string, effect double, p_value double, p_adjusted double")


def scale_changes(tests: DataFrame, order: list[str]) -> DataFrame:
    """(from, to, change) of effects between scales in order."""
    e = {r["support"]: r["effect"] for r in tests.collect()}
    return tests.sparkSession.createDataFrame([(a, b, e[b] - e[a]) for a, b in zip(order, order[1:], strict=False)], "from string, to string, change double")


def invariance(values: DataFrame, maps: dict[str, SupportMap], behaviour: str = "intensive") -> DataFrame:
    """(support, value): the global mean or total after each map, which complete maps leave alike."""
    out = None
    for name, m in maps.items():
        got = aggregate(values.select("ord", F.lit(0).alias("layer_ord"), "value"), m, behaviour, unmapped="drop").select("target_ord", "value")
        if behaviour == "intensive":
            row = got.join(m.target_support(), "target_ord").agg(F.lit(name).alias("support"), (F.sum(F.col("value") * F.col("support")) / F.sum("support")).alias("value"))
        else:
            row = got.agg(F.lit(name).alias("support"), F.sum("value").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def consensus(effects: DataFrame, method: str = "descriptive") -> DataFrame:
    """One row (estimate, std_error, q, tau2) of effects (support, effect, std_error).

    descriptive: the plain mean and no error, as supports share their data;
    fixed or random (DerSimonian-Laird) only for independent ones.
    """
    t = effects.select("effect", "std_error").toPandas() if method != "descriptive" else None
    if method == "descriptive":
        return effects.agg(F.avg("effect").alias("estimate"), F.lit(None).cast("double").alias("std_error"), F.lit(None).cast("double").alias("q"), F.lit(None).cast("double").alias("tau2"))
    e, w = t["effect"].to_numpy(), 1 / t["std_error"].to_numpy() ** 2
    mean = (w * e).sum() / w.sum()
    q = float((w * (e - mean) ** 2).sum())
    tau2 = 0.0
    if method == "random":
        tau2 = max(0.0, (q - (len(e) - 1)) / (w.sum() - (w**2).sum() / w.sum()))
        w = 1 / (1 / w + tau2)
        mean = (w * e).sum() / w.sum()
    return effects.sparkSession.createDataFrame([(float(mean), float(1 / math.sqrt(w.sum())), q, float(tau2))], "estimate double, std_error double, q double, tau2 double")


def leave_one_out(effects: DataFrame, method: str = "fixed") -> DataFrame:
    """(left_out, estimate) of the consensus without each support."""
    names = [r[0] for r in effects.select("support").collect()]
    out = None
    for n in names:
        row = consensus(effects.where(F.col("support") != n), method).select(F.lit(n).alias("left_out"), "estimate")
        out = row if out is None else out.unionByName(row)
    return out


def boundary_test(outcome: DataFrame, predictor: DataFrame, maps: dict[str, SupportMap], control: Permutations = Permutations()) -> DataFrame:  # noqa: B008
    """One row (dispersion, p_value): spread of slopes over an ensemble's maps against shuffled predictors."""
    both = outcome.select("ord", F.col("value").alias("y")).join(predictor.select("ord", F.col("value").alias("x")), "ord").orderBy("ord")
    both = collected(both)
    at = {int(o): k for k, o in enumerate(both["ord"])}
    x, y, shares = both["x"].to_numpy(), both["y"].to_numpy(), []
    for m in maps.values():
        t = collected(m.weights.join(m.support, "source_ord"))
        _, target = np.unique(t["target_ord"], return_inverse=True)
        shares.append((np.array([at[int(o)] for o in t["source_ord"]]), target, (t["weight"] * t["support"]).to_numpy()))

    def spread(v: np.ndarray) -> float:
        over = lambda u, s: np.bincount(s[1], s[2] * u[s[0]]) / np.bincount(s[1], s[2])
        return float(np.std([_effect(over(v, s), over(y, s), "slope") for s in shares], ddof=1))

    found = draws(outcome.sparkSession, control.draws, control.seed, lambda _, rng: [(spread(rng.permutation(x)),)], "spread double").toPandas()["spread"].to_numpy()
    observed = spread(x)
    return outcome.sparkSession.createDataFrame([(observed, float(numeric.permutation_p(observed, found, 0.0, "greater")))], "dispersion double, p_value double")


def maup(effects: DataFrame) -> DataFrame:
    """(source, sum_of_squares, share) of effects (scale, zoning, effect): between scales, zonings in scales; and sign reversals."""
    stats = effects.agg(F.avg("effect").alias("grand"), F.count_if(F.col("effect") > 0).alias("up"), F.count_if(F.col("effect") < 0).alias("down")).first()
    by = effects.groupBy("scale").agg(F.avg("effect").alias("m"), F.count("*").alias("n"), (F.var_pop("effect") * F.count("*")).alias("inside"))
    row = by.agg(F.sum(F.col("n") * (F.col("m") - stats["grand"]) ** 2).alias("between"), F.sum("inside").alias("inside")).first()
    total = (row["between"] or 0) + (row["inside"] or 0)
    rows = [("scale", row["between"], row["between"] / total if total else math.nan), ("zoning", row["inside"], row["inside"] / total if total else math.nan), ("sign_reversals", float(stats["up"] * stats["down"]), math.nan)]
    return effects.sparkSession.createDataFrame(rows, "source string, sum_of_squares double, share double")


#: What results claim: statistic, null and unit of inference.
CONTRACTS = {
    "moran": ("global autocorrelation", "total permutation of values", "element"),
    "geary": ("global dissimilarity of neighbours", "total permutation of values", "element"),
    "local_moran": ("local autocorrelation", "conditional permutation", "element"),
    "getis_ord": ("local concentration", "normal approximation", "element"),
    "common_test": ("effect over regions", "one source-level null for all supports", "support"),
    "group_test": ("group contrast", "Freedman-Lane rearrangement", "unit"),
    "consensus": ("descriptive mean of effects", "none", "support"),
}


def contract(result: str) -> dict[str, str | bool]:
    estimand, null, unit = CONTRACTS[result]
    return {"result": result, "estimand": estimand, "null": null, "unit": unit, "population_inference": False}


def support_family(fit: Callable[[SupportMap], DataFrame], maps: dict[str, SupportMap]) -> DataFrame:
    """A model fitted on every support: its rows with the support's name."""
    out = None
    for name, m in maps.items():
        row = fit(m).withColumn("support", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
