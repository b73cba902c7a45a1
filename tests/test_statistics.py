import numpy as np
import pytest

from latticework.functions import numeric
from latticework import model
from latticework.model import point
from latticework.operators import gis, inference, models, multilayer, statistics, temporal, topology
from latticework.operators.support import SupportMap

SIGNAL = [1, 2, 3, 2, 4, 7, 3, 7, 9]


@pytest.fixture(scope="module")
def grid(spark):
    """Nine points, band 1.01."""
    x = point(spark, [[k % 3, k // 3] for k in range(9)], [[v] for v in SIGNAL])
    w = topology.weights(x, "distance_band", "W", threshold=1.01).cache()
    return x, w


def dense(w, n):
    out = np.zeros((n, n))
    for r in w.collect():
        out[r["i"], r["j"]] = r["w"]
    return out


def test_moran_geary(grid):
    x, w = grid
    v, m = np.array(SIGNAL, float), dense(w, 9)
    z = v - v.mean()
    r = statistics.moran(x.layer(0), w).first()
    assert r["statistic"] == pytest.approx(9 / m.sum() * (z @ m @ z) / (z @ z), abs=1e-12) and r["expected"] == -1 / 8
    c = statistics.geary(x.layer(0), w).first()["statistic"]
    assert c == pytest.approx(8 / (2 * m.sum()) * (m * (v[:, None] - v[None]) ** 2).sum() / (z @ z), abs=1e-12)
    local = {r["ord"]: r for r in statistics.local_moran(x.layer(0), w).collect()}
    assert [local[i]["statistic"] for i in range(9)] == pytest.approx((z * (m @ z) / (z @ z / 9)).tolist())
    assert local[8]["quadrant"] == "high-high" and local[0]["quadrant"] == "low-low"
    assert sum(r["statistic"] for r in local.values()) / 9 == pytest.approx(r["statistic"])


def test_getis_ord(grid):
    x, w = grid
    v = np.array(SIGNAL, float)
    b = (dense(w, 9) > 0) + np.eye(9)
    k = b.sum(1)
    want = (b @ v - v.mean() * k) / (v.std() * np.sqrt((9 * k - k**2) / 8))
    got = {r["ord"]: r["statistic"] for r in statistics.getis_ord(x.layer(0), w).collect()}
    assert [got[i] for i in range(9)] == pytest.approx(want.tolist())


def test_permutations(grid):
    x, w = grid
    r = statistics.permutation_test(x.layer(0), w, "moran", statistics.Permutations(199, 1)).first()
    assert r["statistic"] == pytest.approx(statistics.moran(x.layer(0), w).first()["statistic"]) and 0.005 <= r["p_value"] < 0.1
    again = statistics.permutation_test(x.layer(0).repartition(7), w, "moran", statistics.Permutations(199, 1)).first()
    assert tuple(again) == tuple(r)
    one = {r["ord"]: r["p_value"] for r in statistics.local_permutation_test(x.layer(0), w, statistics.Permutations(99, 1, adjust="holm")).collect()}
    assert all(0.01 <= p <= 1 for p in one.values()) and one[8] < 0.1
    null = statistics.spectral_null(x.layer(0), w, 10, 3).toPandas()
    assert len(null) == 90 and null.groupby("draw")["value"].mean().to_numpy() == pytest.approx(np.mean(SIGNAL))


def test_missing_values_rebuild_weights(grid, spark):
    _, w = grid
    v = spark.createDataFrame([(i, float(x) if i else None) for i, x in enumerate(SIGNAL)], "ord long, value double")
    with pytest.raises(ValueError):
        statistics.retained(v, w)
    good, kept = statistics.retained(v, w, "omit")
    assert good.count() == 8 and {r["i"]: round(r["s"], 9) for r in kept.groupBy("i").agg({"w": "sum"}).withColumnRenamed("sum(w)", "s").collect()} == dict.fromkeys(range(1, 9), 1.0)


def test_variogram(grid):
    x, _ = grid
    got = {r["bin"]: r for r in statistics.variogram(x, breaks=3).collect()}
    at = np.array([[k % 3, k // 3] for k in range(9)], float)
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))[np.triu_indices(9, 1)]
    g = (0.5 * (np.subtract.outer(SIGNAL, SIGNAL)) ** 2)[np.triu_indices(9, 1)]
    bins = np.digitize(d, [d.max() / 3, 2 * d.max() / 3], right=True) + 1
    for b in set(bins):
        assert got[b]["n"] == (bins == b).sum() and got[b]["gamma"] == pytest.approx(g[bins == b].mean()) and got[b]["distance"] == pytest.approx(d[bins == b].mean())


def test_spin(spark):
    rng = np.random.default_rng(1)
    at = rng.normal(size=(50, 3))
    at /= np.linalg.norm(at, axis=1, keepdims=True)
    sphere = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "ord long, x double, y double, z double")
    v = spark.createDataFrame([(i, float(i)) for i in range(50)], "ord long, value double")
    null = statistics.spin_null(v, sphere, 3, 5).toPandas()
    assert len(null) == 150 and set(null["value"]) <= set(map(float, range(50))) and null.groupby("draw")["value"].sum().nunique() > 1


def test_numeric():
    assert numeric.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074065)
    assert numeric.f_sf(4.0, 2, 10) == pytest.approx(1.8**-5)
    assert numeric.normal_quantile(0.975) == pytest.approx(1.959963984540054)
    assert numeric.adjust(np.array([0.01, 0.02, 0.03, np.nan]), "BH").tolist()[:3] == pytest.approx([0.03, 0.03, 0.03])
    assert numeric.adjust(np.array([0.01, 0.02, 0.03]), "holm").tolist() == pytest.approx([0.03, 0.04, 0.04])
    assert numeric.weighted_quantile(np.array([1.0, 2, 3]), np.array([1.0, 1, 2]), 0.5) == 2
    assert numeric.permutation_p(3, [1, 2, 3], 0) == 0.5


def test_space_time(spark):
    x = point(spark, [[0, 0], [1, 0]], [[1, 2, 4], [2, 4, 8]])
    axis = temporal.time_axis([0, 1, 3])
    v = temporal.series(temporal.set_time_axis(x, axis))
    space = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "i long, j long, w double")
    w = temporal.SpaceTime(space, temporal.temporal_weights(axis, spark, style="B"))
    lag = {(r["ord"], r["time_ord"]): r["lag"] for r in temporal.lagged(v, w).collect()}
    assert [[lag[o, t] for t in range(3)] for o in range(2)] == [[2, 4.5, 5], [2.5, 6, 4]]
    assert sum(r["n"] for r in temporal.temporal_variogram(v, 3).collect()) == 6
    full = temporal.materialised(w, x.elements, 3)
    z = np.array([1, 2, 4, 2, 4, 8], float)
    z = z - z.mean()
    m = dense(full, 6)
    assert temporal.spacetime_moran(v, w).first()["statistic"] == pytest.approx(6 / m.sum() * (z @ m @ z) / (z @ z))
    assert {r["ord"]: r["slope"] for r in temporal.trend(v).collect()} == pytest.approx({0: 1.0, 1: 2.0})
    assert {r["ord"]: r["value"] for r in temporal.contrast(v, "integral").collect()} == {0: 7.5, 1: 15.0}
    assert {r["ord"]: r["value"] for r in temporal.change(v, 0, 2, "rate").collect()} == {0: 1.0, 1: 2.0}
    with pytest.raises(ValueError):
        temporal.contrast(v, "sum")
    with pytest.raises(ValueError):
        temporal.time_axis([0, 0])
    assert temporal.time_slice(temporal.set_time_axis(x, axis), between=(0.5, 3)).values.count() == 4
    p = temporal.spacetime_moran_test(v, w, statistics.Permutations(19, 2)).first()
    assert 0.05 <= p["p_value"] <= 1
    pairs = spark.createDataFrame([(0, 1, 1.0)], "i long, j long, distance double")
    assert temporal.spacetime_variogram(v, pairs, [0, 2], [0, 1.5, 3]).agg({"n": "sum"}).first()[0] == 9


def test_solvers(spark):
    a = np.array([[4.0, 1], [1, 3]])
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "i long, j long, w double")

    def operator(v):
        from pyspark.sql import functions as F

        off = models._apply(edges, v, 0.0, 1.0).withColumnRenamed("value", "o")
        return v.join(off, "ord").select("ord", (F.when(F.col("ord") == 0, 4.0).otherwise(3.0) * F.col("value") + F.col("o")).alias("value"))

    b = spark.createDataFrame([(0, 1.0), (1, 2.0)], "ord long, value double")
    for method in ("cg", "bicgstab"):
        x, history = models.solve(operator, b, method, 1e-12)
        assert [r["value"] for r in x.orderBy("ord").collect()] == pytest.approx(np.linalg.solve(a, [1, 2]).tolist()) and history[-1] <= 1e-12
    assert models.logdet(edges, 2, 0.2) == pytest.approx(-0.040821994520255166)
    assert models.logdet(edges, 2, 0.2, exact_up_to=0, order=30) == pytest.approx(-0.040821994520255166, abs=5e-3)
    fitted = models.car(b.withColumn("value", b["ord"] + 1.0), edges.withColumnRenamed("w", "w_raw"), rho=0.5, precision=2.0)
    assert [r["fitted"] for r in fitted.orderBy("ord").collect()] == pytest.approx([0.625, 0.875])


def test_regression_models(spark):
    rng = np.random.default_rng(3)
    n = 49
    at = np.array([[k % 7, k // 7] for k in range(n)], float)
    x = point(spark, at.tolist())
    w = topology.weights(x, "distance_band", "W", threshold=1.01).cache()
    px = rng.normal(size=n)
    m = dense(w, n)
    y = np.linalg.solve(np.eye(n) - 0.5 * m, 1 + 2 * px + 0.1 * rng.normal(size=n))
    t = spark.createDataFrame([(k, float(y[k]), float(px[k]), 0.01) for k in range(n)], "ord long, y double, px double, v double").cache()
    fit = {r["term"]: r["estimate"] for r in models.spatial_lm(t, "y", ["px"], w, "slx").collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(n), px, m @ px]), y, rcond=None)[0]
    assert [fit[k] for k in ("intercept", "px", "lag_px")] == pytest.approx(want.tolist())
    sar = {r["term"]: r["estimate"] for r in models.autoregression(t, w, "y", ["px"]).collect()}
    assert sar["rho"] == pytest.approx(0.5, abs=0.05) and sar["px"] == pytest.approx(2, abs=0.1)
    rough = {r["term"]: r["estimate"] for r in models.autoregression_iterative(t, w, "y", ["px"], grid=41).collect()}
    assert rough["rho"] == pytest.approx(sar["rho"], abs=0.02)
    sure = {r["term"]: r for r in models.autoregression_uncertainty(t, w, "y", ["px"], "v", n=20).collect()}
    assert sure["px"]["low"] < 2.05 and sure["px"]["high"] > 1.95
    gwr = models.gwr(t, x.elements.select("ord", "x", "y"), "y", ["px"], 3.0, dims="xy").toPandas()
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))
    k = np.where(d[10] < 3, (1 - (d[10] / 3) ** 2) ** 2, 0)
    xx = np.column_stack([np.ones(n), px])
    assert gwr[(gwr["ord"] == 10)].set_index("term")["estimate"][["intercept", "px"]].tolist() == pytest.approx(np.linalg.solve(xx.T @ (k[:, None] * xx), xx.T @ (k * y)).tolist())
    b = models.gwr_bandwidth(t, x.elements.select("ord", "x", "y"), "y", ["px"], [2.0, 4.0], dims="xy").collect()
    assert len(b) == 2 and all(r["rmse"] > 0 for r in b)
    values, loads, scores = models.ordination(t, w, ["y", "px"])
    assert len(values) == 2 and scores.count() == n and loads.shape == (2, 2)


def test_kriging(spark):
    h = np.linspace(0.1, 5, 20)
    bins = spark.createDataFrame([(k, float(d), float(models.semivariance("spherical", np.array([d]), 0.5, 2.0, 3.0)[0]), 10) for k, d in enumerate(h)], "bin int, distance double, gamma double, n long")
    fit = models.fit_variogram(bins)
    assert (fit["nugget"], fit["sill"], fit["range"]) == pytest.approx((0.5, 2.0, 3.0), abs=1e-3)
    x = point(spark, [[0, 0], [1, 0], [0, 1], [1, 1]], [[1], [2], [3], [4]])
    fit = {"model": "exponential", "nugget": 0.0, "sill": 1.0, "range": 2.0}
    targets = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.5, 0.5)], "ord long, x double, y double")
    got = {r["ord"]: r for r in models.kriging(x.layer(0), x.elements.select("ord", "x", "y"), targets, fit, 4, dims="xy").collect()}
    assert got[0]["prediction"] == pytest.approx(1) and got[0]["variance"] == pytest.approx(0, abs=1e-9) and got[1]["prediction"] == pytest.approx(2.5)
    cross = models.cross_variograms(spark.createDataFrame([(k, float(k), float(2 * k)) for k in range(4)], "ord long, a double, b double"), x.elements, ["a", "b"], 2.0, 2, "xy")
    names, sill = models.coregionalization(cross, "exponential", 1.0)
    assert names == ["a", "b"] and np.linalg.eigvalsh(sill).min() >= -1e-9 and sill[0, 1] == pytest.approx(2 * sill[0, 0])


def test_basis(spark):
    n = 12
    e = spark.createDataFrame([(a, b, 1.0) for k in range(n - 1) for a, b in ((k, k + 1), (k + 1, k))], "i long, j long, w_raw double")
    mass = spark.createDataFrame([(k, 1.0) for k in range(n)], "ord long, support double")
    basis, modes = multilayer.laplacian_modes(e, mass, 5)
    lam = [r["lambda"] for r in modes.orderBy("mode").collect()]
    assert lam == pytest.approx([2 - 2 * np.cos(np.pi * k / n) for k in range(5)], abs=1e-9)
    values = basis.where("mode = 2").selectExpr("ord", "0 as layer_ord", "phi as value").unionByName(basis.where("mode = 2").selectExpr("ord", "1 as layer_ord", "-2 * phi as value"))
    c = multilayer.project(values, basis, modes, mass)
    assert {(r["layer_ord"], r["mode"]): round(r["coefficient"], 9) for r in c.where("abs(coefficient) > 1e-9").collect()} == {(0, 2): 1.0, (1, 2): -2.0}
    energy = {(r["layer_ord"], r["band"]): r for r in multilayer.band_energy(c, modes, {"low": (0, 2), "mid": (2, 5)}).collect()}
    assert energy[1, "mid"]["energy"] == pytest.approx(4) and energy[1, "mid"]["roughness"] == pytest.approx(lam[2]) and energy[0, "mid"]["share"] == pytest.approx(1)
    index = spark.createDataFrame([("u", "a", 0), ("u", "b", 1)], "unit_id string, feature string, layer_ord int")
    assert multilayer.spectral_coupling(c, index, [("a", "b")]).first()["coupling"] == pytest.approx(-1)
    assert multilayer.wavelet_coupling(c, modes, index, [("a", "b")]).where("abs(coupling + 1) < 1e-9").count() == 5
    got = multilayer.coupling(values, index, [("a", "b")], mass, e.withColumnRenamed("w_raw", "w")).first()
    assert got["same_location"] == pytest.approx(-1) and got["lag_xy"] == pytest.approx(got["lag_yx"])


def test_partial_spectrum():
    n = 700
    degree = np.full(n, 2.0)
    degree[[0, -1]] = 1
    apply = lambda x: degree * x - np.concatenate([[0], x[:-1]]) - np.concatenate([x[1:], [0]])
    lam, u = multilayer.lanczos_smallest(apply, n, 6, 4.0)
    assert lam == pytest.approx(2 - 2 * np.cos(np.pi * np.arange(6) / n), abs=1e-8)
    assert np.abs(u.T @ u - np.eye(6)).max() < 1e-8


def test_group_test(spark):
    import pandas as pd

    rng = np.random.default_rng(2)
    n = 18
    design = pd.DataFrame({"unit_id": [f"u{k}" for k in range(n)], "age": rng.normal(size=n), "group": np.repeat([0.0, 1.0], n // 2)})
    y = rng.normal(size=(n, 3))
    y[:, 0] += 4 * design["group"]
    f = spark.createDataFrame([(f"u{i}", f"e{j}", float(y[i, j])) for i in range(n) for j in range(3)], "unit_id string, endpoint_id string, value double")
    schedule = multilayer.exchangeability(list(design["unit_id"]), draws_=79, seed=1)
    got = {r["endpoint_id"]: r for r in multilayer.group_test(f, design, ["group"], ["age"], schedule).collect()}
    x = np.column_stack([np.ones(n), design["age"], design["group"]])
    beta, inv, rss = numeric.least_squares(x, y[:, 0])
    assert got["e0"]["statistic"] == pytest.approx(beta[2] / np.sqrt(rss / (n - 3) * inv[2, 2]))
    assert got["e0"]["p_max"] == 1 / 80 and all(r["p_max"] >= r["p_value"] for r in got.values())
    assert len(multilayer.exchangeability(["a", "b", "c"], draws_=99)) == 5
    assert len(multilayer.exchangeability(["a", "b", "c", "d"], "within_block", [0, 0, 1, 1], 99)) == 3
    assert len(multilayer.exchangeability(["a", "b", "c"], "sign_flip", draws_=99)) == 7
    two = multilayer.group_test(f, design, ["group", "age"], [], schedule).collect()
    assert len(two) == 3


def test_support_inference(spark, grid):
    x, _ = grid
    own = spark.createDataFrame([(k, 1.0) for k in range(9)], "source_ord long, support double")
    make = lambda f: SupportMap(spark.createDataFrame([(f(k), k, 1.0) for k in range(9)], "target_ord long, source_ord long, weight double"), own)
    maps = {"rows": make(lambda k: k // 3), "columns": make(lambda k: k % 3)}
    p = x.layer(0).selectExpr("ord", "2 * value + ord % 2 as value")
    got = {r["support"]: r for r in inference.common_test(x.layer(0), p, maps, "slope", statistics.Permutations(99, 1)).collect()}
    effect = {r["support"]: r["effect"] for r in inference.region_effects(x.layer(0), p, maps, "slope").collect()}
    assert {k: r["effect"] for k, r in got.items()} == pytest.approx(effect) and all(r["p_adjusted"] >= 0.01 for r in got.values())
    assert inference.robust_effect(x.layer(0), p, maps).where("agree").count() == 2
    assert {r["value"] for r in inference.invariance(x.layer(0), maps).collect()} == {np.mean(SIGNAL)}
    assert 0 < inference.boundary_test(x.layer(0), p, maps, statistics.Permutations(19, 1)).first()["p_value"] <= 1
    e = spark.createDataFrame([("a", 1.0, 0.5), ("b", 2.0, 0.5)], "support string, effect double, std_error double")
    assert inference.consensus(e).first()["estimate"] == 1.5
    fixed = inference.consensus(e, "fixed").first()
    assert fixed["std_error"] == pytest.approx(0.5 / 2**0.5) and fixed["q"] == pytest.approx(2)
    assert inference.consensus(e, "random").first()["tau2"] == pytest.approx(0.25)
    assert inference.leave_one_out(e).count() == 2 and inference.contract("moran")["population_inference"] is False
    assert inference.scale_changes(inference.region_effects(x.layer(0), p, maps), ["rows", "columns"]).count() == 1


def test_gis(spark, grid):
    x, w = grid
    found = gis.landscape(x.layer(0), w, 5.0, "value")
    assert {r["ord"] for r in found.where("active").collect()} == {5, 7, 8} and found.where("patch = 1").count() == 3
    assert gis.patch_table(found, x.elements.selectExpr("ord", "1D as support")).first()["support"] == 3
    assert gis.boundary_edges(x.layer(0), w, 0.9).count() >= 1
    r = gis.resistance_edges(x.layer(0).selectExpr("ord", "0D as value"), w)
    pairs = spark.createDataFrame([(0, 8), (0, 1)], "source long, target long")
    assert {(p["source"], p["target"]): p["distance"] for p in gis.resistance_distance(r, 9, pairs).collect()} == {(0, 8): 4.0, (0, 1): 1.0}
    ohm = {(p["source"], p["target"]): p["distance"] for p in gis.resistance_distance(r, 9, pairs, "effective_resistance").collect()}
    assert ohm[0, 8] == pytest.approx(1.5) and ohm[0, 1] < 1
    assert gis.resistance_distance(r, 9, pairs, "diffusion_distance").count() == 2
    regions = gis.regionalise(x.layer(0).withColumnRenamed("value", "v"), w, ["v"], 3)
    assert regions.select("region").distinct().count() == 3
    frozen = gis.freeze(regions, x.layer(0))
    with pytest.raises(ValueError):
        gis.apply_frozen(x.layer(0), frozen)
    assert gis.apply_frozen(x.layer(0).selectExpr("ord", "value + 1 as value"), frozen).count() == 3
    events = spark.createDataFrame([(0, 1), (1, 2)], "ord long, n long")
    got = gis.pair_enrichment(events, x.elements, [1.0], "xy").first()
    assert got["observed"] == 4 and got["enrichment"] == pytest.approx(4 / (24 * 9 / 81))
    assert gis.enrichment_envelope(events, x.elements, [1.0], 19, dims="xy").first()["p_value"] <= 1
    z = spark.createDataFrame([(o, t, float(v)) for o, s in enumerate(("000", "100", "001", "111", "011", "0101")) for t, v in enumerate(s)], "ord long, time_ord int, z double")
    assert [r["class"] for r in gis.hotspot_classes(z, 1.0).orderBy("ord").collect()] == ["none", "historical", "new", "persistent", "consecutive", "recurrent"]
    v = z.selectExpr("ord", "time_ord", "cast(time_ord as double) as time", "z as value").where("time_ord < 3 and ord < 5")
    hot = gis.hotspots(v, spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "i long, j long, distance double"))
    assert hot.count() == 15 and gis.hotspot_features(hot.selectExpr("*", "'u' as unit_id")).count() == 1
    from latticework.queries import _grid

    s = _grid(spark, 5)
    flat = gis.flatten(s.faces, 25)
    rim = (flat["x"] ** 2 + flat["y"] ** 2).round(9)
    assert (rim == 1).sum() == 16 and rim.max() == 1 and gis.outline(s.faces).count() == 16
    for m in ("orthographic", "pca"):
        assert gis.view(s.elements, m).count() == 25
    faces = gis.map_faces(s.faces, s.elements.selectExpr("ord", "x as value"))
    assert faces.count() == 32 and faces.agg({"colour": "max"}).first()[0] == 256
    assert gis.layout({"a": faces, "b": faces}, shared=True).count() == 2


def test_regions_are_as_many_as_asked_or_an_error(spark):
    star = spark.createDataFrame([(0, float(0)), *[(k, float(k)) for k in range(1, 5)]], "ord long, v double")
    spokes = spark.createDataFrame([(0, k) for k in range(1, 5)], "i long, j long")
    with pytest.raises(ValueError, match="cannot be cut"):
        gis.regionalise(star, spokes, ["v"], 2, 2)
    # the longest edge would leave a side too small to be cut again
    chain = spark.createDataFrame([(k, v) for k, v in enumerate([0.0, 1.0, 2.0, 20.0, 21.0, 22.0])], "ord long, v double")
    steps = spark.createDataFrame([(k, k + 1) for k in range(5)], "i long, j long")
    got = gis.regionalise(chain, steps, ["v"], 3, 2).groupBy("region").count().collect()
    assert sorted(r["count"] for r in got) == [2, 2, 2]
    assert gis.regionalise(chain, steps, ["v"], 2, 3).groupBy("region").count().count() == 2


@pytest.mark.parametrize("n,parts,least", [(9, 2, 2), (12, 3, 3), (14, 4, 2), (15, 5, 3)])
def test_regions_against_every_cut(n, parts, least):
    import itertools
    import random

    for seed in range(20):
        rnd = random.Random(seed)
        tree = [(rnd.random(), rnd.randrange(k), k) for k in range(1, n)]

        def sizes(kept):
            root = list(range(n))
            for _, a, b in kept:
                root = [root[a] if x == root[b] else x for x in root]
            return [root.count(x) for x in set(root)]

        possible = any(min(sizes([e for e in tree if e not in gone])) >= least for gone in itertools.combinations(tree, parts - 1))
        try:
            found = sizes(gis._cut_tree([*range(n)], tree, parts, least))
            assert possible and len(found) == parts and min(found) >= least
        except ValueError:
            assert not possible


def test_variogram_of_too_many_pairs(spark):
    at = spark.range(2000).selectExpr("id as ord", "double(id) as x", "0.0D as y")
    x = model.point(spark, at, spark.range(2000).selectExpr("id as ord", "double(id % 7) as v"))
    with pytest.raises(ValueError, match="pairs"):
        statistics.variogram(x)
    assert statistics.variogram(x, most=3.0).agg({"n": "sum"}).first()[0] == 1999 + 1998 + 1997


def test_trace_series_is_taken_once(spark):
    edges = spark.createDataFrame([(k, k ^ 1, 1.0) for k in range(300)], "i long, j long, w double")
    series = models.traces(edges, 4, 5)
    assert series[:2] == [0.0, 300.0] and series[3] == pytest.approx(300.0)
    assert models.logdet(edges, 300, 0.3, order=4, probes=5) == pytest.approx(models.series_logdet(series, 0.3))


def test_kriging_gates_and_uncertainty(spark):
    at = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.0)], "ord long, x double, y double")
    values = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "ord long, value double")
    goal = spark.createDataFrame([(7, 0.5, 0.5)], "ord long, x double, y double")
    fit = {"model": "exponential", "nugget": 0.1, "sill": 1.0, "range": 3.0}
    base = models.kriging(values, at, goal, fit, 3, dims="xy", weights=True).first()
    w = {r["j"]: r["w"] for r in base["weights"]}
    assert sum(w.values()) == pytest.approx(1) and base["prediction"] == pytest.approx(w[0] + 2 * w[1] + 4 * w[2])
    covariance = spark.createDataFrame([(i, j, 0.5 if i == j else 0.1) for i in range(3) for j in range(3)], "i long, j long, value double")
    support = spark.createDataFrame([(7, 0.25)], "ord long, variance double")
    fits = [{**fit, "range": r} for r in (2.0, 3.0, 4.0)]
    got = models.kriging_uncertainty(values, at, goal, fit, 3, covariance, fits, support, dims="xy").first()
    plain = [models.kriging(values, at, goal, f, 3, dims="xy").first()["prediction"] for f in fits]
    assert got["measurement_variance"] == pytest.approx(sum(w[i] * w[j] * (0.5 if i == j else 0.1) for i in w for j in w))
    assert got["parameter_variance"] == pytest.approx(np.var(plain, ddof=1)) and got["process_variance"] == pytest.approx(base["variance"])
    assert got["std_error"] ** 2 == pytest.approx(got["process_variance"] + got["measurement_variance"] + got["parameter_variance"] + 0.25)
    assert got["high"] - got["prediction"] == pytest.approx(1.959963984540054 * got["std_error"], rel=1e-6)
    with pytest.raises(ValueError, match="condition|semidefinite"):
        models.kriging_system(np.zeros((2, 2)), np.ones(2), np.ones((2, 1)), np.ones(1), ["exponential", 0.0, 1.0, 3.0])


def test_correlogram_permutations(spark):
    n = 12
    values = spark.createDataFrame([(k, float(k)) for k in range(n)] + [(n, float("nan"))], "ord long, value double")
    edges = spark.createDataFrame([(a, b, 1.0, 1.0) for a in range(n) for b in (a - 1, a + 1) if 0 <= b < n], "i long, j long, w_raw double, w double")
    got = statistics.correlogram_test(values, edges, 3, statistics.Permutations(99, 1, adjust="maxT"), "omit").orderBy("order").collect()
    plain = {r["order"]: r["statistic"] for r in statistics.correlogram(values.where("not isnan(value)"), edges, 3).collect()}
    assert [r["statistic"] for r in got] == pytest.approx([plain[r["order"]] for r in got])
    assert got[0]["p_value"] <= 0.02 and all(r["p_adjusted"] >= r["p_value"] - 1e-12 for r in got)
    with pytest.raises(ValueError):
        statistics.correlogram_test(values, edges, 3)
