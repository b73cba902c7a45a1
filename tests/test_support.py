import pytest
from pyspark.sql import functions as F

from latticework import model
from latticework.model import Measure, make, point, volume
from latticework.operators import support as S


def smap(spark, rows, support, kind="crisp", coverage="complete"):
    w = spark.createDataFrame([(t, s, float(v)) for t, row in enumerate(rows) for s, v in enumerate(row) if v], "target_ord long, source_ord long, weight double")
    s = spark.createDataFrame([(k, float(v)) for k, v in enumerate(support)], "source_ord long, support double")
    return S.support_map(w, s, kind, coverage)


def layer(spark, values):
    return spark.createDataFrame([(k, 0, float(v)) for k, v in enumerate(values)], "ord long, layer_ord int, value double")


def got(df, column="value"):
    return [r[column] for r in df.orderBy("target_ord").collect()]


CRISP = [[1, 1, 0, 0], [0, 0, 1, 1]]


def test_crisp(spark):
    m = smap(spark, CRISP, [1, 2, 1, 2])
    assert got(m.target_support(), "support") == [3, 3]
    assert got(S.aggregate(layer(spark, [10, 20, 30, 40]), m, "intensive")) == pytest.approx([50 / 3, 110 / 3], abs=1e-12)
    assert got(S.aggregate(layer(spark, [1, 2, 3, 4]), m, "extensive")) == [3, 7]
    assert got(S.aggregate(layer(spark, [1, 1, 2, 2]), m, "categorical")) == [1, 2]


def test_probabilistic_and_overlapping(spark):
    m = smap(spark, [[0.8, 0.2, 0, 0], [0.2, 0.8, 1, 1]], [1, 2, 1, 2], "probabilistic")
    assert got(m.target_support(), "support") == pytest.approx([1.2, 4.8])
    assert got(S.aggregate(layer(spark, [10, 20, 30, 40]), m, "intensive")) == pytest.approx([13.333333333333334, 30])
    assert got(S.aggregate(layer(spark, [1, 2, 3, 4]), m, "extensive")) == pytest.approx([1.2, 8.8])
    m = smap(spark, [[1, 1, 1, 0], [0, 1, 1, 1]], [1, 2, 1, 2], "overlapping")
    assert got(m.target_support(), "support") == [4, 5]
    with pytest.raises(ValueError):
        S.aggregate(layer(spark, [1, 2, 3, 4]), m, "extensive")
    assert got(S.aggregate(layer(spark, [1, 2, 3, 4]), m, "extensive", "normalize")) == [3.5, 6.5]


def test_contracts(spark):
    for rows, kind in (([[0.5, 1, 0, 0], [0, 0, 1, 1]], "crisp"), ([[1, 1, 0, 0], [1, 0, 1, 1]], "probabilistic"), ([[1, 1, 0, 0], [0, 0, 1, 0]], "crisp"), ([[-1, 1, 1, 1]], "crisp")):
        with pytest.raises(ValueError):
            smap(spark, rows, [1, 1, 1, 1], kind)
    m = smap(spark, CRISP, [1, 1, 1, 1])
    with pytest.raises(ValueError):
        S.aggregate(layer(spark, [1, 2, 3, 4]), m, "unknown")
    with pytest.raises(ValueError):
        S.aggregate(layer(spark, [1, 2, float("nan"), 4]), m, "intensive")
    partial = smap(spark, [[1, 1, 0, 0]], [1, 1, 1, 1], coverage="partial")
    with pytest.raises(ValueError):
        S.aggregate(layer(spark, [1, 2, 3, 4]), partial, "extensive")
    assert got(S.aggregate(layer(spark, [1, 2, 3, 4]), partial, "extensive", unmapped="drop")) == [3]


def test_categorical_ties_take_the_smallest(spark):
    m = smap(spark, CRISP, [1, 1, 1, 1])
    assert got(S.aggregate(layer(spark, [5, 3, 7, 9]), m, "categorical")) == [3, 7]


def test_dataset_aggregation(spark):
    measures = [Measure("a", support_behavior="intensive"), Measure("b", support_behavior="count"), Measure("c", support_behavior="categorical")]
    x = point(spark, [[0, 0], [1, 0], [2, 0], [3, 0]], [[10, 1, 1], [20, 2, 1], [30, 3, 2], [40, 4, 2]], measures=measures)
    target = make(spark, "region", spark.range(2).withColumnRenamed("id", "ord"))
    y = S.aggregate_to(x, target, smap(spark, CRISP, [1, 2, 1, 2]))
    assert {(r["ord"], r["layer_ord"]): round(r["value"], 9) for r in y.values.collect()} == {(0, 0): 16.666666667, (1, 0): 36.666666667, (0, 1): 3, (1, 1): 7, (0, 2): 1, (1, 2): 2}
    labels = spark.createDataFrame([(0, "A"), (1, "A"), (2, "B"), (3, "B")], "ord long, region_id string")
    z = S.aggregate_regions(x, labels)
    assert sorted((r["ord"], r["layer_ord"], r["value"]) for r in z.values.where("layer_ord = 1").collect()) == [(0, 1, 3.0), (1, 1, 7.0)]


def test_compose_and_atlases(spark):
    a = smap(spark, CRISP, [1, 2, 1, 2])
    up = smap(spark, [[1, 1]], [3, 3])
    both = S.compose(a, up)
    assert (both.kind, both.coverage) == ("crisp", "complete") and both.weights.count() == 4
    b = smap(spark, [[1, 0, 0, 1], [0, 1, 1, 0]], [1, 2, 1, 2])
    assert {(r[0], r[1]): r[2] for r in S.atlas_overlap(a, b).collect()} == {(0, 0): 1, (0, 1): 2, (1, 0): 2, (1, 1): 1}
    assert {r["first_ord"]: r["second_ord"] for r in S.atlas_compare(a, b).collect()} == {0: 1, 1: 0}
    v = spark.createDataFrame([(0, 10.0), (1, 40.0)], "ord long, value double")
    assert {r["ord"]: r["value"] for r in S.cross_atlas(v, a, b).collect()} == pytest.approx({0: 30.0, 1: 20.0})
    assert {r["ord"]: r["value"] for r in S.cross_atlas(v, a, b, "extensive").collect()} == pytest.approx({0: 30.0, 1: 20.0})
    graph = S.OperatorGraph((("s", "m", "1"), ("m", "t", "2")), {"1": a, "2": up})
    assert graph.path("s", "t").weights.count() == 4


def test_probability_atlas(spark):
    p = spark.createDataFrame([(0, 0, 0.8), (0, 1, 0.2), (1, 0, 0.3), (1, 1, 0.7), (2, 1, 1.0)], "source_ord long, target_ord long, weight double")
    s = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 1.0)], "source_ord long, support double")
    m = S.probabilistic_map(p, s)
    assert m.coverage == "complete" and got(m.target_support(), "support") == pytest.approx([1.4, 2.6])
    h = {r[0]: r[1] for r in S.entropy(m).collect()}
    assert h[2] == 0 and 0 < h[0] < h[1] < 1


def test_grid_maps(spark):
    half = volume(spark, (1, 1, 1), [[1, 0, 0, 0.5], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    two = volume(spark, (2, 1, 1), [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    assert sorted((r[0], r[2]) for r in S.affine_grid_map(half, two, "trilinear").weights.select("target_ord", "source_ord", "weight").collect()) == [(0, 0.5), (1, 0.5)]
    m = S.voxel_overlap_map(half, two)
    assert sorted((r["target_ord"], r["weight"]) for r in m.weights.collect()) == [(0, 0.5), (1, 0.5)] and m.kind == "probabilistic"
    assert [r["target_ord"] for r in S.affine_grid_map(two, two).weights.orderBy("source_ord").collect()] == [0, 1]
    with pytest.raises(ValueError):
        S.affine_grid_map(two, half)
    fine = volume(spark, (8, 8, 4), [[0.5, 0, 0, -0.25], [0, 0.5, 0, -0.25], [0, 0, 0.5, -0.25], [0, 0, 0, 1]])
    coarse = volume(spark, (4, 4, 2), [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    sums = S.voxel_overlap_map(fine, coarse).weights.groupBy("target_ord").agg(F.sum("weight").alias("w")).collect()
    assert len(sums) == 32 and all(abs(r["w"] - 8) < 1e-9 for r in sums)


def test_surface_maps(spark):
    from latticework.queries import _grid

    a = _grid(spark, 3)
    ident = S.nearest_map(a, a)
    assert ident.kind == "crisp" and ident.coverage == "complete" and ident.weights.where("target_ord <> source_ord").count() == 0
    p = point(spark, [[0.25, 0.25, 0.0], [1.5, 1.5, 2.0]])
    m = S.barycentric_map(p, a, 4, support=spark.createDataFrame([(0, 1.0), (1, 1.0)], "source_ord long, support double"))
    w = {(r["source_ord"], r["target_ord"]): round(r["weight"], 9) for r in m.weights.collect()}
    assert {k: v for k, v in w.items() if k[0] == 0} == {(0, 0): 0.5, (0, 1): 0.25, (0, 3): 0.25}
    assert abs(sum(v for k, v in w.items() if k[0] == 1) - 1) < 1e-9


def test_uncertainty(spark):
    m = smap(spark, CRISP, [1, 1, 1, 1])
    c = spark.createDataFrame([(i, j, 4.0 if i == j else 1.0) for i in range(4) for j in range(4)], "i long, j long, value double")
    assert got(S.uncertainty(m, c), "variance") == pytest.approx([2.5, 2.5])
    assert S.covariance_violations(c).count() == 0
    assert S.covariance_violations(c.where("not (i = 0 and j = 1)")).count() >= 1
    v = layer(spark, [10, 20, 30, 40])
    var = v.select("ord", "layer_ord", F.lit(4.0).alias("variance"))
    assert got(S.variance(v, var, m, "intensive"), "variance") == pytest.approx([2, 2])
    assert got(S.variance(v, var, m, "extensive"), "variance") == pytest.approx([8, 8])
    c = S.condition(m)
    assert c["sigma_max"] == pytest.approx(2**0.5) and c["stable_rank"] == pytest.approx(2)
    noisy = S.SupportMap(m.weights.withColumn("weight_var", F.lit(0.01)), m.support)
    d = S.monte_carlo(noisy, 20, 1)
    assert d.groupBy("draw", "source_ord").agg(F.sum("weight").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    assert S.boundary_sensitivity([m, smap(spark, [[1, 0, 0, 0], [0, 1, 1, 1]], [1, 1, 1, 1])]).collect()[1]["disagreement"] == 0.25
    assert S.ensemble([m, m], [1, 3]).weights == (0.25, 0.75)
    rmse = S.sensitivity(point(spark, [[0, 0]] * 4, [[1], [2], [3], [4]]), None, [m, m], "intensive").collect()
    assert rmse[1]["rmse"] == 0


def test_resampling(spark):
    x = volume(spark, (2, 1, 1), [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]], values=[[10, 3], [20, 7]], measures=[Measure("a", support_behavior="intensive"), Measure("b", support_behavior="extensive")])
    plan = S.ResamplingPlan("nearest")
    with pytest.raises(PermissionError):
        plan.resample(x, x)
    y = plan.resample(x, x, authorize=True)
    assert sorted((r["ord"], r["layer_ord"], r["value"]) for r in y.values.collect()) == [(0, 0, 10.0), (0, 1, 3.0), (1, 0, 20.0), (1, 1, 7.0)]


def test_barycentric_map_looks_at_all_triangles(spark):
    """One large triangle near the vertex, many small ones whose centroids are nearer."""
    at, faces = [(-50.0, -50.0, 0.1), (50.0, -50.0, 0.1), (0.0, 70.0, 0.1)], [(0, 1, 2)]
    for k in range(20):
        x = 0.1 * k
        n = len(at)
        at += [(x, 0.0, 5.0), (x + 0.05, 0.0, 5.0), (x, 0.05, 5.0)]
        faces.append((n, n + 1, n + 2))
    target = model.surface(spark, at, faces)
    source = model.point(spark, [(0.0, 0.0, 0.0), (1.0, 0.0, 4.9)])
    got = S.barycentric_map(source, target, 4, support=spark.createDataFrame([(0, 1.0), (1, 1.0)], "source_ord long, support double")).weights.collect()
    near = {s: {r["target_ord"] for r in got if r["source_ord"] == s} for s in (0, 1)}
    assert near[0] == {0, 1, 2} and min(near[1]) >= 3
