"""Sums over pairs within a radius, against all pairs by numpy, with many tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import gis, models, reach, statistics, topology


@pytest.fixture(scope="module")
def places(spark):
    rng = np.random.default_rng(3)
    at, v = rng.normal(size=(300, 2)) * 0.3, rng.normal(size=300)
    at[:40] = at[0]  # one place that many share
    rows = [(i, float(x), float(y), float(z)) for i, ((x, y), z) in enumerate(zip(at, v, strict=True))]
    rows += [(300, float("nan"), 0.0, 1.0), (301, None, 0.0, 1.0)]
    gaps = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))
    return spark.createDataFrame(rows, "ord long, x double, y double, value double"), gaps, v


@pytest.fixture(autouse=True)
def many_tiles(monkeypatch):
    monkeypatch.setattr(reach, "LEAST", 8)
    monkeypatch.setattr(reach, "ROWS", 7)
    monkeypatch.setattr(reach, "COLUMNS", 11)




def test_tiles(spark, places, monkeypatch):
    table, gaps, _ = places
    monkeypatch.setattr(reach, "MOST", 8)
    t = reach.tiled(table, "xy")
    sizes = [r["count"] for r in t.rows.groupBy("_t").count().collect()]
    assert sum(sizes) == 300 and len(t.boxes) > 8 and max(sizes) < 40


def test_fits_and_errors(spark, places):
    table, gaps, v = places
    w = np.where(gaps <= 0.3, np.exp(-0.5 * (gaps / 0.1) ** 2), 0.0)
    got = {r["ord"]: r for r in models.kernel_regression(table, table, "value", [], 0.1, dims="xy").collect()}
    assert sorted(got) == list(range(300))
    assert [got[i]["estimate"] for i in range(300)] == pytest.approx((w @ v / w.sum(1)).tolist())
    assert [got[i]["effective_n"] for i in range(300)] == pytest.approx((w.sum(1) ** 2 / (w * w).sum(1)).tolist())
    out = w * (1 - np.eye(300)) * (np.arange(300)[:, None] % 5 != np.arange(300)[None] % 5)
    some = out.sum(1) > 0
    (row,) = models.gwr_bandwidth(table, table, "value", [], [0.1], "gaussian", "xy", folds=5).collect()
    assert (row["n"], row["rmse"]) == (some.sum(), pytest.approx(np.sqrt(((v - out @ v / np.where(some, out.sum(1), 1))[some] ** 2).mean())))
    # what is missing shows only where it is in reach
    gone = table.withColumn("value", F.when(F.col("ord") != 7, F.col("value")))
    got = {r["ord"]: r["estimate"] for r in models.kernel_regression(gone, table, "value", [], 0.1, dims="xy").collect()}
    assert [np.isnan(got[i]) for i in range(300)] == (gaps[7] <= 0.3).tolist()


def test_pairs_and_their_plan(spark, places):
    """Weights of a band: no exchange reads the pairs."""
    table, gaps, _ = places
    near = (gaps <= 0.25) & ~np.eye(300, dtype=bool)
    w = near * np.exp(-0.5 * (gaps / 0.1) ** 2)
    df = topology.weights_within(table, 0.25, lambda d: np.exp(-0.5 * (d / 0.1) ** 2), "xy")
    got = {(r["i"], r["j"]): r["w"] for r in df.collect()}
    assert got.keys() == {(i, j) for i, j in zip(*np.nonzero(near), strict=True)}
    share = w / w.sum(1, keepdims=True, where=near, initial=1e-300)
    assert all(abs(share[k] - x) < 1e-12 for k, x in got.items())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.index("MapInArrow") < plan.index("Exchange")
    far = {(r["i"], r["j"]) for r in topology.weights_within(table, 0.25, lambda d: 1 / d, "xy", "none", apart=True).collect()}
    assert far == {(i, j) for i, j in zip(*np.nonzero(near & (gaps > 0)), strict=True)}


def test_variograms_and_counts(spark, places):
    table, gaps, v = places
    i, j = np.triu_indices(300, 1)
    d, g = gaps[i, j], 0.5 * (v[i] - v[j]) ** 2
    at = np.maximum(1, np.ceil(d / 0.1 - 1e-12)).astype(int)
    want = {b: (d[at == b].mean(), g[at == b].mean(), (at == b).sum()) for b in range(1, 6)}
    got = {r["bin"]: (r["distance"], r["gamma"], r["n"]) for r in statistics.binned_within(table, table, 0.5, 5, "xy").collect()}
    assert got.keys() == want.keys() and all(got[b] == pytest.approx(want[b]) for b in want)
    old = {r["bin"]: (r["distance"], r["gamma"], r["n"]) for r in statistics.binned(statistics.variogram_pairs(table, table, 0.5, "xy"), 5, 0.5).collect()}
    assert all(got[b] == pytest.approx(old[b]) for b in old)
    # a missing value leaves its pairs counted, and out of the mean
    gone = table.withColumn("value", F.when(F.col("ord") != 7, F.col("value")))
    old = statistics.binned(statistics.variogram_pairs(gone, table, 0.5, "xy"), 5, 0.5).orderBy("bin").collect()
    assert statistics.binned_within(gone, table, 0.5, 5, "xy").orderBy("bin").select("n").collect() == [(r["n"],) for r in old]
    assert [r[0] for r in statistics.binned_within(gone, table, 0.5, 5, "xy").orderBy("bin").select("gamma").collect()] == pytest.approx([r["gamma"] for r in old])
    events = table.where("value > 0").select("ord", F.lit(2).alias("n"))
    n = 2.0 * (v > 0)
    got = {r["radius"]: r["observed"] for r in gis.pair_enrichment(events, table, [0.1, 0.3], "xy").collect()}
    assert got == {r: float((np.outer(n, n) * (gaps <= r) * (1 - np.eye(300))).sum()) for r in (0.1, 0.3)}
