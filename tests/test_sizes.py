"""What must not grow with the table: jobs, driver matrices, rows of one task."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework import model
from latticework.operators import gis, models, multilayer, statistics, support, topology
from latticework.sources import exchange


@pytest.fixture
def collects(monkeypatch):
    n, own = [], DataFrame.toPandas
    for cls in {type_ for type_ in DataFrame.__subclasses__() if "toPandas" in vars(type_)} | {DataFrame}:
        own = cls.toPandas
        monkeypatch.setattr(cls, "toPandas", lambda self, own=own: n.append(1) or own(self))
    return n


def test_blocks_are_read_together(spark, collects):
    at = spark.range(300).select(F.col("id").alias("ord"), *[F.lit(0.0).alias(c) for c in "xyz"])
    x = model.point(spark, at, at.where("ord % 7 > 0").select("ord", F.col("ord").cast("double").alias("a"), F.lit(1.0).alias("b")))
    found = list(model.value_blocks(x, 16, ["a"]))
    assert len(collects) <= 2  # 19 before
    assert [b["ord"].tolist() for b in found] == [[k for k in range(s, min(s + 16, 300)) if k % 7] for s in range(0, 300, 16)]
    whole = list(model.value_blocks(x, 128))
    assert [len(b) for b in whole] == [2 * sum(k % 7 > 0 for k in range(s, min(s + 128, 300))) for s in (0, 128, 256)]


def test_many_planar_features(spark):
    x = model.point(spark, spark.range(100_001).select(F.col("id").alias("ord"), *[F.lit(0.5).alias(c) for c in "xyz"]))
    assert model.planar_features(x).count() == 100_001
    with pytest.raises(ValueError, match="limit"):
        model.planar_features(x, most=10)


def test_chunks_are_read_together(spark, collects, tmp_path, monkeypatch):
    w = spark.range(95).where("id not between 30 and 45").select((F.col("id") % 3).alias("target_ord"), F.col("id").alias("source_ord"), (F.col("id") / 7).alias("weight"))
    m = support.SupportMap(w, spark.range(120).select(F.col("id").alias("source_ord"), F.lit(2.0).alias("support")))
    exchange.write_bundle(m, str(tmp_path / "one"), 10)
    assert len(collects) < 6  # 13 before
    monkeypatch.setattr(exchange, "SLAB", 25)
    exchange.write_bundle(m, str(tmp_path / "two"), 10)
    one, two = (exchange.validate_bundle(str(tmp_path / k)) for k in ("one", "two"))
    assert one == two and len(one["chunks"]) == 12 and one["source_ord"] == list(range(120))
    got = exchange.read_bundle(spark, str(tmp_path / "two"))
    assert sorted(got.weights.collect()) == sorted(w.collect()) and got.support.count() == 120
    exchange.write_map(m, str(tmp_path / "map"))
    assert sorted(exchange.read_map(spark, str(tmp_path / "map")).weights.collect()) == sorted(w.collect())


def test_many_units(spark):
    """A projection on 20,000 units is never a matrix of units by units (3 GB)."""
    import resource

    n, rng = 20_000, np.random.default_rng(1)
    x, y = rng.normal(size=n), rng.normal(size=n)
    features = spark.createDataFrame(pd.DataFrame({"unit_id": [f"{k:05d}" for k in range(n)], "endpoint_id": "a", "value": y}))
    design = pd.DataFrame({"unit_id": [f"{k:05d}" for k in range(n)], "x": x})
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    (row,) = multilayer.group_test(features, design, ["x"], [], multilayer.exchangeability(design["unit_id"].tolist(), draws_=3)).collect()
    r = np.corrcoef(x, y)[0, 1]
    assert row["statistic"] == pytest.approx(r * np.sqrt((n - 2) / (1 - r * r)))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20


def test_draws_of_elements_are_dealt_out(spark):
    v = spark.range(40).select(F.col("id").alias("ord"), F.sin("id").alias("value"))
    edges = v.select(F.col("ord").alias("i"), ((F.col("ord") + 1) % 40).alias("j"), F.lit(1.0).alias("w_raw"))
    df = statistics.local_permutation_test(v, topology.styled(edges), statistics.Permutations(9, 1))
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(k for k, line in enumerate(lines) if "MapInPandas" in line)
    assert "Repartition" in lines[at + 1]


def test_components_are_solved_by_themselves(spark, monkeypatch):
    """Components of 1 to 4 elements, more elements than one dense matrix takes, batches that part them; against the whole matrix."""
    monkeypatch.setattr(models, "DENSE", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        n, rng = 60, np.random.default_rng(5)
        a = np.zeros((n, n))
        for k in range(n - 1):
            if k % 4 in (0, 1, 2) and k % 12 != 1:
                a[k, k + 1] = a[k + 1, k] = rng.uniform(0.1, 1)
        y = rng.normal(size=n)
        values = spark.createDataFrame([(3 * k, float(v)) for k, v in enumerate(y)], "ord long, value double")
        edges = spark.createDataFrame([(3 * int(i), 3 * int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "i long, j long, w_raw double")
        s = np.linalg.inv(np.eye(n) / 4 + 2 * (np.diag(a.sum(1)) - 0.5 * a))
        got = {r["ord"]: r for r in models.car_uncertainty(values, edges, 4.0, "proper", 0.5, 2.0).collect()}
        assert [got[3 * k]["mean"] for k in range(n)] == pytest.approx((s @ y / 4).tolist())
        assert [got[3 * k]["std_error"] for k in range(n)] == pytest.approx(np.sqrt(np.diag(s)).tolist())
        found = models.component_logdet(edges.withColumnRenamed("w_raw", "w"), 0.4)
        assert found == pytest.approx(np.linalg.slogdet(np.eye(n) - 0.4 * a)[1], abs=1e-12)
        chain = spark.range(20).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), F.lit(1.0).alias("w_raw"))
        with pytest.raises(ValueError, match="connected"):
            models.car_uncertainty(spark.range(21).select(F.col("id").alias("ord"), F.lit(1.0).alias("value")), chain, 4.0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_autoregression_beyond_a_dense_spectrum(spark, monkeypatch):
    """By levels as by the dense spectrum, with an element that has no neighbours."""
    rng, n = np.random.default_rng(4), 90
    at = spark.createDataFrame([(k + 5, float(x), float(y)) for k, (x, y) in enumerate(rng.normal(size=(n, 2)))], "ord long, x double, y double")
    near = topology.symmetric(topology.nearest(at.where("ord > 5"), at.where("ord > 5"), 3, "xy").drop("rank"))
    edges = topology.styled(near.select("i", "j", F.lit(1.0).alias("w_raw"))).cache()
    table = at.select("ord", (F.col("x") + F.sin("ord")).alias("v"), F.col("y").alias("px"))
    t = edges.toPandas()
    i, j, v = t["i"].to_numpy() - 5, t["j"].to_numpy() - 5, t["w"].to_numpy()
    level = models.levels(i, j, n)
    assert (np.abs(level[i] - level[j]) <= 1).all() and level.min() == 0
    w = np.zeros((n, n))
    w[i, j] = v
    for rho in (-0.9, 0.3, 0.95):
        assert models.levels_logdet(i, j, v, level, rho) == pytest.approx(np.linalg.slogdet(np.eye(n) - rho * w)[1])
    for kind in ("sar", "sem"):
        want = {r["term"]: r["estimate"] for r in models.autoregression(table, edges, "v", ["px"], kind).collect()}
        with monkeypatch.context() as m:
            m.setattr(models, "DENSE", 10)
            got = {r["term"]: r["estimate"] for r in models.autoregression(table, edges, "v", ["px"], kind).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-5, abs=1e-6) for k in want)


def test_columns_at_once(spark):
    rng, n = np.random.default_rng(6), 50
    a = rng.uniform(size=(n, n)) * (rng.uniform(size=(n, n)) < 0.1)
    a[7] = 0
    i, j = np.nonzero(a)
    x, out = rng.normal(size=(n, 3)), np.zeros((n, 3))
    for rows, steps in multilayer._jagged(i, j, a[i, j], n, 16):
        for columns, weights in steps:
            out[rows[: len(columns)]] += weights * x[columns]
    assert np.allclose(out, a @ x)


def test_regions_take_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(gis, "components", lambda *_: pytest.fail("rounds of joins"))
    v = spark.createDataFrame([(10 * k, float(k + 50 * (k > 3) + 90 * (k > 6))) for k in range(9)], "ord long, v double")
    edges = v.select(F.col("ord").alias("i"), (F.col("ord") + 10).alias("j")).where("j < 90")
    got = gis.regionalise(v, edges, ["v"], 3).orderBy("ord").collect()
    assert [tuple(r) for r in got] == [(10 * k, 1 + (k > 3) + (k > 6)) for k in range(9)]
