import numpy as np
import pytest

from latticework import model
from latticework.model import composite, point, surface, volume
from latticework.operators import graph, topology

TETRA = [(0, 0, 0), (1, 0, 0), (0.5, 0.8660254037844386, 0), (0.5, 0.2886751345948129, 0.8164965809277260)]
FACES = [(0, 1, 2), (0, 1, 3), (1, 2, 3), (2, 0, 3)]
EYE = [[2, 0, 0, -2], [0, 2, 0, -2], [0, 0, 2, -2], [0, 0, 0, 1]]


def edges(df):
    return sorted((r["i"], r["j"]) for r in df.where("i < j").collect())


def test_tetrahedron(spark):
    x = surface(spark, TETRA, FACES, [[10], [20], [30], [40]])
    assert edges(topology.adjacency(x)) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    assert [r["area"] for r in topology.triangles(x).collect()] == pytest.approx([0.4330127018922193] * 4, abs=1e-12)
    assert [r["area"] for r in topology.vertex_area(x).collect()] == pytest.approx([0.4330127018922193] * 4, abs=1e-12)
    regions = spark.createDataFrame([(0, "A"), (1, "A"), (2, "B"), (3, "B")], "ord long, region_id string")
    assert [tuple(r) for r in topology.region_adjacency(topology.adjacency(x), regions, "edge_count").collect()] == [("A", "B", 4.0)]
    assert topology.boundary(topology.adjacency(x), regions).count() == 4


def test_masked_volume(spark):
    mask = np.zeros((3, 3, 3), bool)
    for v in ((0, 0, 0), (1, 0, 0), (1, 1, 0), (1, 1, 1)):
        mask[v] = True
    x = volume(spark, (3, 3, 3), EYE, mask)
    assert [tuple(r) for r in x.elements.orderBy("ord").select("ord", "source_index", "i", "j", "k", "x").collect()] == [(0, 0, 0, 0, 0, -2.0), (1, 1, 1, 0, 0, 0.0), (2, 4, 1, 1, 0, 0.0), (3, 13, 1, 1, 1, 0.0)]
    assert topology.voxel_volume(x) == pytest.approx(8) and edges(topology.adjacency(x)) == [(0, 1), (1, 2), (2, 3)]
    assert edges(topology.adjacency(x, 26)) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    assert edges(topology.adjacency(x, 18)) == [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]


def test_composite_has_no_edge_across(spark):
    a = surface(spark, TETRA, FACES)
    x = composite({"left": a, "right": a, "deep": volume(spark, (2, 1, 1), EYE)})
    found = topology.adjacency(x)
    assert edges(found) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (4, 5), (4, 6), (4, 7), (5, 6), (5, 7), (6, 7), (8, 9)]
    assert [r["component"] for r in topology.connected(x, found).orderBy("ord").collect()] == [1] * 4 + [2] * 4 + [3] * 2


def test_components_of_a_long_chain(spark):
    n = 200
    e = spark.createDataFrame([(k * 7 % n, (k + 1) * 7 % n) for k in range(n - 1) if k != 120], "i long, j long")
    got = graph.components(e, spark.range(n).withColumnRenamed("id", "ord"))
    parts = {}
    for r in got.collect():
        parts.setdefault(r["root"], set()).add(r["ord"])
    want = [{k * 7 % n for k in range(121)}, {k * 7 % n for k in range(121, n)}]
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want)) and all(k == min(v) for k, v in parts.items())


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(0)
    at = np.concatenate([rng.normal(size=(60, 3)), rng.normal(size=(20, 3)) * 0.01 + 5, np.zeros((5, 3)), [[90, 90, 90]]])
    x = point(spark, at.tolist())
    got = {(r["i"], r["rank"]): (r["j"], round(r["distance"], 9)) for r in topology.nearest(x.elements, x.elements, 4).collect()}
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))
    for i in range(len(at)):
        order = sorted((round(d[i, j], 9), j) for j in range(len(at)) if j != i)[:4]
        assert [got[i, k + 1] for k in range(4)] == [(j, v) for v, j in order]


def test_nearest_of_few(spark):
    x = point(spark, [[0, 0], [0, 0], [1, 0]])
    assert topology.nearest(x.elements, x.elements, 5, "xy").count() == 6
    assert topology.nearest(x.elements, x.elements.where("false"), 2, "xy", same=False).count() == 0


def test_paths(spark):
    x = surface(spark, TETRA, FACES)
    one = spark.createDataFrame([(0,)], "ord long")
    d = {r["target"]: r["distance"] for r in topology.distance(x, one, method="edge_geodesic").collect()}
    assert d[0] == 0 and d[1] == pytest.approx(1)
    chain = point(spark, [[k, 0, 0] for k in range(5)])
    e = spark.createDataFrame([(a, b, 1.0) for k in range(4) for a, b in ((k, k + 1), (k + 1, k))], "i long, j long, length double")
    assert {r["target"]: r["distance"] for r in graph.shortest(e, 5, one, most=3).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    assert {(r["i"], r["j"]): r["order"] for r in graph.shells(e, 3).where("i = 0").collect()} == {(0, 1): 1, (0, 2): 2, (0, 3): 3}
    assert topology.distance(chain, one, most=2.0).count() == 3
    with pytest.raises(ValueError):
        topology.distance(chain, x.elements, pairs=3)


def test_weights(spark):
    x = point(spark, [[0, 0], [1, 0], [3, 0]])
    w = {(r["i"], r["j"]): r["w"] for r in topology.weights(x, "knn", k=1).collect()}
    assert w == {(0, 1): 1.0, (1, 0): 0.5, (1, 2): 0.5, (2, 1): 1.0}
    assert topology.weights(x, "knn", k=1, symmetry="mutual").count() == 2
    assert topology.weights(x, "knn", k=1, symmetry="directed").count() == 3
    assert {(r["i"], r["j"]): r["w"] for r in topology.weights(x, "distance_band", "B", threshold=2.0).collect()} == {(0, 1): 1, (1, 0): 1, (1, 2): 1, (2, 1): 1}
    assert {r["w"] for r in topology.weights(x, "inverse_distance", "none", threshold=2.0).collect()} == {1.0, 0.5}
    with pytest.raises(ValueError):
        topology.weights(point(spark, [[0, 0], [0, 0]]), "inverse_distance", threshold=1.0)
    assert [r["neighbours"] for r in topology.neighbour_lists(topology.neighbours(x, "knn", k=1)).orderBy("i").collect()] == [[1], [0, 2], [1]]


def test_report(spark):
    x = surface(spark, TETRA, FACES, [[1, 1], [1, 2], [1, float("nan")], [1, 4]])
    found = {r["check"]: (r["status"], r["n"]) for r in topology.quality_report(x, topology.adjacency(x)).collect()}
    assert found["constant_layers"] == ("warning", 1) and found["nonfinite_values"][1] == 1 and found["isolates"] == ("pass", 0) and found["overall"][0] == "warning"


def test_cotangent(spark):
    x = surface(spark, TETRA, FACES)
    # every angle is 60 degrees and every edge has two triangles
    w = [r["w_raw"] for r in topology.cotangent(x).collect()]
    assert len(w) == 12 and w == pytest.approx([1 / 3**0.5] * 12)


def test_chart_distortion_is_kept(spark):
    x = model.surface(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 2)])
    flat = x.elements.select("ord", "x", "y")
    assert model.chart_distortion(model.set_chart(x, flat, "flat", {"area": 0.1})) == {"area": 0.1}
    assert model.chart_distortion(model.set_chart(x, flat, "flat"), "flat") is None
    with pytest.raises(KeyError):
        model.chart_distortion(x)


def test_older_containers(spark):
    old = {
        "domain": {"type": "points", "space": {"space_id": "s", "kind": "template", "unit": "mm"}, "elements": [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}]},
        "values": [[1.0, 5.0], [2.0, 6.0]], "maps": [{"map_id": "m1", "name": "a", "measure_id": "q"}, {"map_id": "m2", "name": "b", "measure_id": "q"}],
        "measures": [{"measure_id": "q", "units": "mm", "spatial_semantics": "intensive", "default_aggregation": "weighted_mean"}], "labels": {"own": ["u", "v"]}, "provenance": {"by": "hand"},
    }
    x = model.migrate_legacy(spark, old)
    assert x.kind == "point" and x.space.unit == "mm" and x.behaviour("a") == "intensive" and [h["operation"] for h in x.history] == ["source", "migrate_legacy"]
    assert sorted(map(tuple, x.values.collect())) == [(0, 0, 1.0), (0, 1, 5.0), (1, 0, 2.0), (1, 1, 6.0)] and x.layers.where("layer_id = 'm2'").first()["name"] == "b"
    for bad in ({}, {**old, "domain": {"type": "cubes"}}, {**old, "maps": [{"map_id": "m1", "measure_id": "none"}, old["maps"][1]]}):
        report = model.migrate_legacy(spark, bad)
        assert report["status"] == "reconstruction_required" and report["issues"] and report["field_map"]["maps"] == "layers"
