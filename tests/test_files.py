import json
import os

import numpy as np
import pytest

from latticework.model import Measure, Space, base_signature, bind_layers, layer_view, point, relation, subset, surface, update_measure, validate, volume
from latticework.operators import spaces, temporal
from latticework.operators.support import SupportMap
from latticework.plans import provenance as P
from latticework.sources import exchange, formats, readers

EYE = [[2.0, 0, 0, -2], [0, 2, 0, -2], [0, 0, 2, -2], [0, 0, 0, 1]]


def test_nifti_round_trip():
    rng = np.random.default_rng(0)
    image = formats.Image(rng.normal(size=(3, 4, 2, 5)).astype("f4").astype(float), np.array(EYE))
    for version in (1, 2):
        for compress in (False, True):
            raw = formats.write_nifti(image, "f4", compress, version)
            back = formats.read_nifti(raw)
            assert (back.data == image.data).all() and (back.affine == image.affine).all()
            assert (formats.read_nifti(raw, frames=[3]).data[..., 0] == image.data[..., 3]).all()
    with pytest.raises(ValueError):
        formats.read_nifti(formats.write_nifti(image)[:-4])
    with pytest.raises(ValueError):
        formats.read_nifti(b"nothing here")


def test_other_round_trips():
    rng = np.random.default_rng(1)
    mgh = formats.Image(rng.normal(size=(3, 2, 2, 2)).astype("f4").astype(float), np.array(EYE))
    back = formats.read_mgh(formats.write_mgh(mgh, True))
    assert (back.data == mgh.data).all() and back.affine == pytest.approx(mgh.affine)
    v, f = rng.normal(size=(4, 3)).astype("f4"), np.array([[0, 1, 2], [1, 2, 3]])
    a, b = formats.read_surface(formats.write_surface(v, f))
    assert (a == v).all() and (b == f).all()
    assert formats.read_curv(formats.write_curv(np.arange(4.0)))[:, 0].tolist() == [0, 1, 2, 3]
    names = {1 + (2 << 8) + (3 << 16): ("one", (1, 2, 3, 0)), 9: ("two", (9, 0, 0, 0))}
    keys, got = formats.read_annot(formats.write_annot(np.array([9, 9, 1 + (2 << 8) + (3 << 16)]), names))
    assert keys.tolist()[:2] == [9, 9] and got == names
    arrays, labels = formats.read_gifti(formats.write_gifti([("NIFTI_INTENT_POINTSET", v), ("NIFTI_INTENT_TRIANGLE", f)], {1: ("x", (0.5, 0, 0, 1))}))
    assert (arrays[0][1] == v).all() and (arrays[1][1] == f).all() and labels[1] == ("x", (0.5, 0.0, 0.0, 1.0))
    models = [{"structure": "LEFT", "type": "surface", "vertices": np.array([0, 2]), "n_vertices": 3}, {"structure": "DEEP", "type": "voxels", "voxels": np.array([[0, 0, 0], [1, 0, 0]])}]
    for kind, more in (("dscalar", {"names": ["a", "b"]}), ("dtseries", {"series": (0.0, 2.0, "SECOND")}), ("dlabel", {"labels": {k: (str(k), (0.0, 0.0, 0.0, 1.0)) for k in range(8)}})):
        c = formats.Cifti(np.arange(8.0).reshape(4, 2), models, kind, dim=(2, 1, 1), affine=np.array(EYE), **more)
        d = formats.read_cifti(formats.write_cifti(c))
        assert (d.data == c.data).all() and d.kind == kind and [m["count"] for m in d.models] == [2, 2] and d.models[0]["vertices"].tolist() == [0, 2]
    with pytest.raises(ValueError):
        formats.write_cifti(formats.Cifti(np.full((4, 1), 99.0), models, "dlabel", labels={0: ("a", (0, 0, 0, 1))}))


def test_datasets_in_files(spark, tmp_path):
    mask = np.zeros((3, 3, 3), bool)
    mask[0, 0, 0] = mask[1, 1, 1] = mask[2, 2, 2] = True
    x = volume(spark, (3, 3, 3), EYE, mask, [[1, 4], [2, 5], [3, 6]], measures=Measure(support_behavior="intensive"))
    path = f"{tmp_path}/a.nii.gz"
    readers.write(x, path)
    with pytest.raises(FileExistsError):
        readers.write(x, path)
    assert json.loads(open(f"{tmp_path}/a.json").read())["layers"][0]["name"] == "layer_1"
    y = readers.read(spark, path, mask=mask)
    rows = lambda d: sorted(map(tuple, d.values.select("ord", "layer_ord", "value").collect()))
    assert rows(y) == rows(x) and readers.read(spark, path, mask=mask, frames=[1]).values.count() == 3
    assert readers.image_values(spark, str(tmp_path / "*.nii.gz")).count() == 54
    readers.write(x, f"{tmp_path}/a.mgh")
    assert rows(readers.read(spark, f"{tmp_path}/a.mgh", mask=mask)) == rows(x)
    s = surface(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 2)], [[1], [2], [3]])
    readers.write(s, f"{tmp_path}/s.gii")
    assert readers.read_gifti(spark, f"{tmp_path}/s.gii", f"{tmp_path}/s.gii").faces.count() == 1
    open(f"{tmp_path}/lh.white", "wb").write(formats.write_surface(np.eye(3), np.array([[0, 1, 2]])))
    open(f"{tmp_path}/lh.thick", "wb").write(formats.write_curv(np.arange(3.0)))
    assert rows(readers.read_freesurfer(spark, f"{tmp_path}/lh.white", f"{tmp_path}/lh.thick")) == [(0, 0, 0.0), (1, 0, 1.0), (2, 0, 2.0)]
    c = formats.Cifti(np.arange(6.0).reshape(3, 2), [{"structure": "LEFT", "type": "surface", "vertices": np.array([0, 1, 2]), "n_vertices": 3}], "dtseries", series=(0.0, 1.5, "SECOND"))
    open(f"{tmp_path}/t.dtseries.nii", "wb").write(formats.write_cifti(c))
    t = readers.read(spark, f"{tmp_path}/t.dtseries.nii")
    assert t.time_axis.time == (0.0, 1.5) and t.values.count() == 6


def test_raw_matrix(spark, tmp_path):
    data = np.arange(40.0).reshape(10, 4)
    open(f"{tmp_path}/m.bin", "wb").write(b"head" + data.astype("<f4").tobytes())
    got = readers.raw_values(spark, f"{tmp_path}/m.bin", 10, 4, dtype="<f4", offset=4, block=3, frames=[1, 3], slope=2)
    assert sorted((r["ord"], r["layer_ord"], r["value"]) for r in got.collect()) == [(i, k, 2 * data[i, c]) for i in range(10) for k, c in enumerate((1, 3))]
    assert got.rdd.getNumPartitions() == 4
    with pytest.raises(Exception, match="size"):
        readers.raw_values(spark, f"{tmp_path}/m.bin", 11, 4, dtype="<f4", offset=4).collect()
    readers.copy_raw(f"{tmp_path}/m.bin", f"{tmp_path}/n.bin")
    assert open(f"{tmp_path}/n.bin", "rb").read() == open(f"{tmp_path}/m.bin", "rb").read()


def test_map_exchange(spark, tmp_path):
    w = spark.createDataFrame([(0, 0, 0.25), (1, 0, 0.75), (1, 1, 1.0), (0, 2, 1.0)], "target_ord long, source_ord long, weight double")
    m = SupportMap(w, spark.createDataFrame([(k, k + 0.5) for k in range(3)], "source_ord long, support double"), "probabilistic")
    exchange.write_map(m, f"{tmp_path}/m")
    rows = lambda x: sorted(map(tuple, x.weights.select("target_ord", "source_ord", "weight").collect()))
    assert rows(exchange.read_map(spark, f"{tmp_path}/m")) == rows(m)
    exchange.migrate(spark, f"{tmp_path}/m", f"{tmp_path}/b", chunk=2)
    back = exchange.read_map(spark, f"{tmp_path}/b")
    assert rows(back) == rows(m) and back.kind == "probabilistic" and len(exchange.validate_bundle(f"{tmp_path}/b")["chunks"]) == 2
    with open(f"{tmp_path}/b/chunk-00001.mtx", "a") as f:
        f.write("1 1 1.0\n")
    with pytest.raises(ValueError):
        exchange.read_bundle(spark, f"{tmp_path}/b")


def test_names_and_manifests(spark, tmp_path):
    name = "sub-01_ses-2_space-fs_hemi-L_desc-x_thickness.shape.gii"
    parsed = P.parse_name(f"/a/{name}")
    assert P.build_name(**parsed) == name and parsed["suffix"] == "thickness"
    for bad in ("ses-2_sub-01_x.nii", "sub-01_sub-02_x.nii", "foo-1_x.nii"):
        with pytest.raises(ValueError):
            P.parse_name(bad)
    x = point(spark, [[0, 0], [1, 1]], [[1, 2], [3, 4]])
    m = P.object_manifest(x)
    assert P.validate_manifest(m, x) == [] and P.validate_manifest({**m, "kind": "volume"}) != []
    P.write_json(m, f"{tmp_path}/m.json")
    assert P.validate_manifest(P.read_json(f"{tmp_path}/m.json"), x) == []
    P.write_derivative(x, f"{tmp_path}/sub-1_x.tsv", lambda _, p: open(p, "w").write("v"), {"sub": "1"}, strict=True)
    assert P.validate_sidecar(P.read_json(f"{tmp_path}/sub-1_x.json"), x, "sub-1_x.tsv") == []
    assert P.validate_dag(P.history_dag(["a", "b"], [("a", "b")]))
    with pytest.raises(ValueError):
        P.history_dag(["a", "b"], [("a", "b"), ("b", "a")])
    y = x.noted("read", path="/secret/file", hash="abc")
    assert P.export_history(y, "paths")[0]["path"] == "file" and P.export_history(y, "all")[0] == {"operation": "read"}
    b = P.write_batch(f"{tmp_path}/batch", {"a.txt": lambda p: open(p, "w").write("a")})
    assert P.read_batch(f"{tmp_path}/batch") == json.loads(json.dumps(b))
    with open(f"{tmp_path}/batch/a.txt", "w") as f:
        f.write("b")
    assert P.validate_artifacts(b, f"{tmp_path}/batch") == ["changed a.txt"]

    def fails(_):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        P.write_batch(f"{tmp_path}/batch", {"a.txt": fails}, overwrite=True)
    assert os.path.exists(f"{tmp_path}/batch/a.txt")


def test_replay(spark):
    x = temporal.set_time_axis(point(spark, [[0, 0], [1, 1]], [[1, 2, 4], [3, 4, 9]]), temporal.time_axis([0, 1, 3]))
    steps = [P.Step("s", "time_slice", "x", {"index": [0, 2]}), P.Step("c", "change", "s", {"before": 0, "after": 1, "scale": "rate"})]
    manifest, out = P.record({"x": x}, steps)
    assert sorted(r["value"] for r in out["c"].values.collect()) == [1.0, 2.0]
    assert P.replay(manifest, {"x": x}, "exact").keys() == {"c"}
    with pytest.raises(ValueError):
        P.replay(manifest, {"x": subset(x, [0])})
    with pytest.raises(ValueError):
        P.Step("d", "drop_everything", "x", {})


def test_model(spark):
    x = surface(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)], [(0, 1, 2), (1, 3, 2)], [[1, 5], [2, 6], [3, 7], [4, 8]], measures=[Measure("a"), Measure("b", support_behavior="count")])
    assert {r["check"]: r["violations"] for r in validate(x, "strict").collect() if r["violations"]} == {}
    assert validate(x, "scientific").where("violations > 0").count() == 3
    y = subset(x, [1, 2, 3], [1])
    assert [tuple(r) for r in y.faces.select("v1", "v2", "v3").collect()] == [(0, 2, 1)] and sorted(r["value"] for r in y.values.collect()) == [6, 7, 8]
    assert y.measures.count() == 1 and base_signature(y) != base_signature(x)
    z = bind_layers(x, x, conflicts="prefix")
    assert z.layers.count() == 4 and z.values.count() == 16
    with pytest.raises(ValueError):
        bind_layers(x, x)
    with pytest.raises(ValueError):
        bind_layers(x, y, conflicts="prefix")
    assert layer_view(x, "layer_2").values.count() == 4 and x.behaviour(1) == "count"
    assert update_measure(x, "a", support_behavior="intensive").measures.where("measure_id = 'a'").first()["aggregation"] == "weighted_mean"
    r = relation(x, spark.createDataFrame([(3, 0, 1.0)], "from_ord long, to_ord long, value double"), "flow")
    assert tuple(r.data.first()) == (0, 3, 1.0)
    for rows, kind in (([(0, 1, 1.0), (1, 0, 1.0)], "flow"), ([(0, 9, 1.0)], "flow"), ([(0, 1, 1.0)], "distance")):
        with pytest.raises(ValueError):
            relation(x, spark.createDataFrame(rows, "from_ord long, to_ord long, value double"), kind)


def test_spaces(spark):
    a, b, c = Space("a", unit="mm"), Space("b", unit="mm"), Space("c", unit="m")
    reg = spaces.Registry().register(a, ("first",)).register(b).register(c)
    assert reg.resolve("first") == a and reg.resolve("b") == b and reg.resolve(spaces.space_hash(c)) == c
    shift = [[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]
    ab, bc = spaces.Transform(a, b, matrix=shift), spaces.Transform(b, c, matrix=EYE)
    g = spaces.TransformGraph(reg).add(ab, "ab").add(bc, "bc")
    assert g.path("a", "c") == [("ab", False), ("bc", False)] and g.diagnostics()["incompatible"] == ["bc"]
    with pytest.raises(ValueError):
        g.path("c", "a")
    assert g.path("b", "a", allow_inverse=True) == [("ab", True)]
    with pytest.raises(ValueError):
        g.add(ab, "again").path("a", "b")
    x = point(spark, [[0, 0, 0]], space=a)
    with pytest.raises(PermissionError):
        spaces.apply_path(x, g, g.path("a", "c"))
    y = spaces.apply_path(x, g, g.path("a", "c"), authorize=True)
    assert tuple(y.elements.select("x", "y", "z").first()) == (0.0, -2.0, -2.0) and y.space == c
    assert tuple(spaces.apply(y, g.composed(g.path("a", "c")).invert()).elements.select("x", "y", "z").first()) == (0.0, 0.0, 0.0)


def test_streams(spark, tmp_path):
    from latticework.streaming import windows

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(3).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e").withColumnRenamed("event_type", "layer")
    q = windows.summaries(stream, late="60 days").writeStream.outputMode("complete").format("memory").queryName("days").start()
    try:
        q.processAllAvailable()
        assert spark.sql("select sum(n) from days").first()[0] == e.count()
    finally:
        q.stop()
    m = SupportMap(e.select("user_id").distinct().selectExpr("user_id % 2 as target_ord", "user_id as source_ord", "1D as weight"), e.select("user_id").distinct().selectExpr("user_id as source_ord", "1D as support"))
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e").selectExpr("user_id as ord", "ts", "value")
    q = windows.aggregated(stream, m, "extensive", late="60 days").writeStream.outputMode("complete").format("memory").queryName("sums").start()
    try:
        q.processAllAvailable()
        assert spark.sql("select sum(value) from sums").first()[0] == pytest.approx(e.agg({"value": "sum"}).first()[0])
    finally:
        q.stop()


def test_examples(spark):
    from latticework.sources import examples

    for name, h in examples.manifest().items():
        x = examples.load(spark, name, h)
        assert x.values.count() == x.elements.count()
    with pytest.raises(ValueError):
        examples.load(spark, "voxels", "0")
