"""Registered queries on uncertainty, group tests, bases, flat maps and dense files, with their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from latticework import model
from latticework.operators import gis, inference, models, multilayer, statistics, support, temporal, topology
from latticework.plans import provenance
from latticework.queries import _DAYS, _E, _KNN, _customers, _days, _knn, _label, _layer, _points, _r, _table, query
from latticework.queries_base import _lattice, _scratch, _set, _sheet
from latticework.queries_more import _PAIRED, _effects, _paired
from latticework.sources import formats, readers

# --- uncertainty of models


@query(_E + ", k as (select i, exp(-0.5 * (d / 0.2) * (d / 0.2)) w, e.v, 0.1 + abs(e.x) q from (select i, j, d from cand where d <= 0.6 union all select ord, ord, 0.0 from e) c join e on e.ord = c.j) select i as ord, 'intercept' as term, round(sum(w*v) / sum(w), 6) as estimate, round(sqrt(sum(w*w*q)) / sum(w), 7) as std_error from k group by 1")
def local_fit_errors(spark, sf):  # noqa: ANN001, ANN201
    p = _points(spark, sf)
    t = p.select("ord", "value", (0.1 + F.abs("x")).alias("q"))
    return models.gwr_uncertainty(t, p.select("ord", "x", "y"), "value", [], 0.2, "q", "gaussian", "xy").select("ord", "term", _r("estimate"), _r("std_error", 7))


@query(_PAIRED + ", q as (select ord, y, o, case when o is null then 0.25 else 2.25 end a, case when o is null then 0.0 else 1.0 end b from p) select ord, round((a * y + b * coalesce(o, 0)) / (a * a - b * b) / 4, 5) as mean, round(sqrt(a / (a * a - b * b)), 8) as std_error from q")
def autoregressive_posterior(spark, sf):  # noqa: ANN001, ANN201
    """On pairs: the inverse of [[1/4 + 2, -1], [-1, 1/4 + 2]]."""
    v, edges = _paired(spark, sf)
    return models.car_uncertainty(v, edges, 4.0, "proper", 0.5, 2.0).select("ord", _r("mean", 5), _r("std_error", 8))


@query("with m as (select avg(c_acctbal) m from customer), f as (select m + d e, s, w from m, (values (0.0, 1.0, 0.5), (3.0, 2.0, 0.3), (-1.0, 0.5, 0.2)) t(d, s, w)), g as (select sum(w * e) e, sum(w * s * s) wi from f), b as (select sum(w * (f.e - g.e) * (f.e - g.e)) b from f, g) select 'mean' as term, round(e, 6) as estimate, round(wi, 8)::double as within, round(b, 8)::double as between, round(sqrt(wi + b), 8) as std_error from g, b".replace(" as between", " as \"between\""))
def models_averaged(spark, sf):  # noqa: ANN001, ANN201
    share = F.when(F.col("support") == "nation", 0.5).when(F.col("support") == "segment", 0.3).otherwise(0.2)
    fits = _effects(spark, sf).select(F.col("support").alias("model"), F.lit("mean").alias("term"), F.col("effect").alias("estimate"), "std_error", share.alias("weight"))
    return models.model_ensemble(fits).select("term", _r("estimate"), _r("within", 8), _r("between", 8), _r("std_error", 8))


@query("with t as (select p_retailprice t, p_retailprice + p_size - 25 e, p_retailprice + p_size - 35 l, p_retailprice + p_size - 15 h from part) select round(avg(e - t), 6) as bias, round(sqrt(avg((e - t) * (e - t))), 6) as rmse, round(avg(case when t >= l and t <= h then 1.0 else 0.0 end), 8) as coverage, round(avg(h - l), 6) as width from t")
def model_calibration(spark, sf):  # noqa: ANN001, ANN201
    t = _table(spark, sf, "part").select(F.col("p_retailprice").alias("truth"), (F.col("p_retailprice") + F.col("p_size") - 25).alias("estimate"))
    t = t.withColumn("low", F.col("estimate") - 10).withColumn("high", F.col("estimate") + 10)
    return models.calibration(t).select(_r("bias"), _r("rmse"), _r("coverage", 8), _r("width"))


@query("with v as (select c_acctbal y, cast(c_custkey % 97 as double) x, c_nationkey n, c_mktsegment s from customer), a as (select avg(y) y, avg(x) x from v group by n), b as (select avg(y) y, avg(x) x from v group by s) select 'nation' as support, round(regr_slope(y, x), 5) as estimate from a union all select 'segment', round(regr_slope(y, x), 5) from b")
def models_by_support(spark, sf):  # noqa: ANN001, ANN201
    v, m = _customers(spark, sf)
    x = v.select("ord", (F.col("ord") % 97).cast("double").alias("value"))

    def fit(one):  # noqa: ANN001, ANN202
        y, z = (support.aggregate(_layer(t, "value"), one, "intensive").select("target_ord", F.col("value").alias(c)) for t, c in ((v, "y"), (x, "x")))
        return models.spatial_lm(y.join(z, "target_ord").withColumnRenamed("target_ord", "ord"), "y", ["x"]).where("term = 'x'")

    return inference.support_family(fit, {k: m[k] for k in ("nation", "segment")}).select("support", _r("estimate", 5))


@query(_E + ", g as (select cast(k as bigint) ord, cast(k % 10 as double) / 5 - 1 x, cast(k // 10 as double) / 5 - 1 y from range(100) t(k)), p as (select g.ord o, e.v, e.ord j, 0.1 + abs(e.x) q, sqrt((g.x-e.x)*(g.x-e.x)+(g.y-e.y)*(g.y-e.y)) d from g, e), n as (select * from (select *, row_number() over (partition by o order by d, j) rn from p) where rn = 1) select o as ord, round(case when d > 0 then 2 * (1 + 8 * (1 - exp(-6 * d))) else 0 end, 6) as process_variance, round(q, 8) as measurement_variance, 0.0::double as parameter_variance, 0.5::double as support_variance, round(sqrt(case when d > 0 then 2 * (1 + 8 * (1 - exp(-6 * d))) else 0 end + q + 0.5), 6) as std_error from n")
def kriging_errors(spark, sf):  # noqa: ANN001, ANN201
    at = _points(spark, sf)
    grid = spark.range(100).select(F.col("id").alias("ord"), (F.col("id") % 10 / 5 - 1).alias("x"), (F.floor(F.col("id") / 10) / 5 - 1).alias("y"))
    fit = {"model": "exponential", "nugget": 1.0, "sill": 8.0, "range": 0.5}
    covariance = at.select(F.col("ord").alias("i"), F.col("ord").alias("j"), (0.1 + F.abs("x")).alias("value"))
    # the same fit three times leaves no variance of its parameters
    found = models.kriging_uncertainty(at.select("ord", "value"), at.select("ord", "x", "y"), grid, fit, 1, covariance, [fit] * 3, grid.select("ord", F.lit(0.5).alias("variance")), dims="xy")
    return found.select("ord", _r("process_variance"), _r("measurement_variance", 8), _r("parameter_variance", 8), "support_variance", _r("std_error"))


@query(_E + ", k as (select i, exp(-0.5 * (d / 0.3) * (d / 0.3)) w, e.v from cand join e on e.ord = j where d <= 0.9 and i % 5 <> j % 5), s as (select i, sum(w*v) / sum(w) m from k group by 1) select 0.3::double as bandwidth, round(sqrt(avg((v - m) * (v - m))), 6) as rmse, count(*) as n from s join e on e.ord = i")
def bandwidth_errors_by_fold(spark, sf):  # noqa: ANN001, ANN201
    p = _points(spark, sf)
    return models.gwr_bandwidth(p.select("ord", "value"), p.select("ord", "x", "y"), "value", [], [0.3], "gaussian", dims="xy", folds=5).select("bandwidth", _r("rmse"), "n")


_KERNEL = "with recursive v as (select cast(n_nationkey as bigint) o, t, cast((n_nationkey * 7 + t * t * 3 + n_regionkey * 5) % 11 as double) x from nation, range(4) r(t)), k as (select a.o, a.t, b.x, exp(-abs(a.o - b.o) / 2.0 - abs(a.t - b.t) - abs(a.o - b.o) / 2.0 * abs(a.t - b.t)) w from v a join v b on abs(a.o - b.o) <= 2), s as (select o, t, sum(w * x) p, sum(w) w, sum(w * w) q from k group by 1, 2), m as (select avg(x) m, stddev_pop(x) d, count(*) n from v) "


def _field(spark, sf):  # noqa: ANN001, ANN202
    """Nations in a row at four times, with values made of their keys, and the pairs no more than two apart."""
    n = _table(spark, sf, "nation")
    k = F.col("n_nationkey").cast("long")
    v = n.select(k.alias("ord"), "n_regionkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("time_ord"))
    v = v.select("ord", "time_ord", F.col("time_ord").cast("double").alias("time"), ((F.col("ord") * 7 + F.col("time_ord") * F.col("time_ord") * 3 + F.col("n_regionkey") * 5) % 11).cast("double").alias("value"))
    near = n.select(k.alias("i"), F.explode(F.array(*[k + d for d in (-2, -1, 1, 2)])).alias("j")).join(n.select(k.alias("j")), "j", "left_semi")
    return v, near.select("i", "j", F.abs(F.col("i") - F.col("j")).cast("double").alias("distance"))


@query(_KERNEL + "select o as ord, cast(t as integer) as time_ord, round((p - m * w) / (d * sqrt((n * q - w * w) / (n - 1))), 7) as z from s, m")
def hotspot_scores(spark, sf):  # noqa: ANN001, ANN201
    v, near = _field(spark, sf)
    return gis.hotspots(v, near, bandwidth=2.0).select("ord", F.col("time_ord").cast("int").alias("time_ord"), _r("z", 7))


@query(_KERNEL + "select o as ord, cast(t as integer) as time_ord, round((p - m * w) / (d * sqrt((n * q - w * w) / (n - 1))), 7) as z, true as ordered from s, m")
def hotspot_permutations(spark, sf):  # noqa: ANN001, ANN201
    """The scores again, and that no adjusted p-value is below its own."""
    v, near = _field(spark, sf)
    found = gis.hotspot_test(v, near, bandwidth=2.0, control=statistics.Permutations(49, 5))
    return found.select("ord", "time_ord", _r("z", 7), ((F.col("p_max") >= F.col("p_value")) & (F.col("p_value") >= 0.02) & (F.col("p_max") <= 1)).alias("ordered"))


# --- groups, bases and couplings


@query("select * from (values ('free', 5), ('within_block', 3), ('sign_flip', 7)) t(scheme, rearrangements)")
def rearrangements(spark, sf):  # noqa: ANN001, ANN201
    units = ["a", "b", "c"]
    rows = [("free", len(multilayer.exchangeability(units))), ("within_block", len(multilayer.exchangeability(["a", "b", "c", "d"], "within_block", [0, 0, 1, 1]))), ("sign_flip", len(multilayer.exchangeability(units, "sign_flip")))]
    return spark.createDataFrame(rows, "scheme string, rearrangements int")


@query(_DAYS + ", u as (select ord, avg(value) a, max(value) b, min(value) c from v group by 1), f as (select 'mean' e, a y, cast(ord as double) x from u union all select 'most', b, cast(ord as double) from u), r as (select e, corr(y, x) r, count(*) n from f group by 1) select e as endpoint_id, round(r * sqrt((n - 2) / (1 - r * r)), 6) as statistic from r")
def group_statistics(spark, sf):  # noqa: ANN001, ANN201
    u = _days(spark, sf).groupBy("ord").agg(F.avg("value").alias("mean"), F.max("value").alias("most"))
    features = u.select(F.col("ord").cast("string").alias("unit_id"), F.inline(F.array(*[F.struct(F.lit(c).alias("endpoint_id"), F.col(c).alias("value")) for c in ("mean", "most")])))
    units = sorted(r[0] for r in u.select("ord").collect())
    design = pd.DataFrame({"unit_id": [str(k) for k in units], "x": np.array(units, dtype=float)})
    found = multilayer.group_test(features, design, ["x"], [], multilayer.exchangeability(design["unit_id"].tolist(), draws_=19))
    return found.select("endpoint_id", _r("statistic"))


@query("select cast(k as integer) as mode, round(2 - 2 * cos(pi() * k / n), 7) + 0.0 as \"lambda\" from range(6) t(k), (select count(*) n from nation)")
def chain_spectrum(spark, sf):  # noqa: ANN001, ANN201
    """Smallest eigenvalues of the Laplacian of nations in a row."""
    k = _table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("ord"))
    edges = k.select(F.col("ord").alias("i"), F.explode(F.array(F.col("ord") - 1, F.col("ord") + 1)).alias("j"), F.lit(1.0).alias("w_raw")).join(k.select(F.col("ord").alias("j")), "j", "left_semi")
    _, modes = multilayer.laplacian_modes(edges, k.select("ord", F.lit(1.0).alias("support")), 6)
    return modes.select(F.col("mode").cast("int").alias("mode"), (F.round(F.greatest("lambda", F.lit(0.0)), 7) + 0.0).alias("lambda"))


_COEFFICIENTS = "with c as (select l_linenumber m, sum(l_quantity) a, sum(l_tax * 100) b from lineitem group by 1) "


def _spectrum(spark, sf):  # noqa: ANN001, ANN202
    """Line numbers as modes, two layers of sums as coefficients."""
    c = _table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("mode")).agg(F.sum("l_quantity").alias("a"), F.sum(F.col("l_tax") * 100).alias("b"))
    coefficients = c.select("mode", F.inline(F.array(*[F.struct(F.lit(n).alias("layer_ord"), F.col(k).alias("coefficient")) for n, k in enumerate("ab")])))
    return coefficients, c.select("mode", (F.col("mode") / 7.0).alias("lambda")), spark.createDataFrame([("u", "q", 0), ("u", "t", 1)], "unit_id string, feature string, layer_ord int")


@query(_COEFFICIENTS + ", s as (select s, power(s * m / 7.0 * exp(-s * m / 7.0), 2) w, a, b from c, (select unnest([0.25, 1.0, 4.0]) s)) select 'u' as unit_id, 'q|t' as pair, cast(s as double) as scale, round(sum(w*a*b) / sqrt(sum(w*a*a) * sum(w*b*b)), 8) as coupling from s group by s")
def wavelet_couplings(spark, sf):  # noqa: ANN001, ANN201
    coefficients, modes, index = _spectrum(spark, sf)
    return multilayer.wavelet_coupling(coefficients, modes, index, [("q", "t")], (0.25, 1, 4)).select("unit_id", "pair", "scale", _r("coupling", 8))


@query(_COEFFICIENTS + ", t as (select 0 as layer_ord, m, a x from c union all select 1, m, b from c), e as (select layer_ord, case when m < 4 then 'low' else 'high' end band, x * x q, m / 7.0 l from t), n as (select layer_ord, sum(q) t from e group by 1) select layer_ord, band, round(sum(q) / max(t), 8) as share, round(sum(q * l) / sum(q), 8) as roughness from e join n using (layer_ord) group by 1, 2")
def energy_by_band(spark, sf):  # noqa: ANN001, ANN201
    coefficients, modes, _ = _spectrum(spark, sf)
    return multilayer.band_energy(coefficients, modes, {"low": (0, 4), "high": (4, 99)}).select("layer_ord", "band", _r("share", 8), _r("roughness", 8))


@query(_KNN + ", t as (select sum(w.w * a.z * b.z) top from w join z a on a.ord = w.i join z b on b.ord = w.j) select 1 as axis, round(top / m2, 8) as eigenvalue from t, m")
def ordination_axis(spark, sf):  # noqa: ANN001, ANN201
    """Of a single layer the axis is the layer, and its eigenvalue z'Wz / z'z."""
    values, _, _ = models.ordination(_label(spark, sf), _knn(spark, sf), ["value"], 1)
    return spark.createDataFrame([(1, round(float(values[0]), 8))], "axis int, eigenvalue double")


@query("select * from (values ('moran', 'element', false), ('group_test', 'unit', false), ('consensus', 'support', false)) t(result, unit, population_inference)")
def inference_contracts(spark, sf):  # noqa: ANN001, ANN201
    rows = [inference.contract(k) for k in ("moran", "group_test", "consensus")]
    return spark.createDataFrame([(r["result"], r["unit"], r["population_inference"]) for r in rows], "result string, unit string, population_inference boolean")


# --- regions and flat maps


@query("with p as (select p_partkey k, p_retailprice v from part), d as (select k, abs(v - lag(v) over (order by k)) d from p), c as (select k from d where d is not null order by d desc, k limit 4) select p.k as ord, dense_rank() over (order by (select count(*) from c where c.k <= p.k)) as region from p")
def regions_of_chain(spark, sf):  # noqa: ANN001, ANN201
    """Parts in a row: the tree is the row, and it is cut at the four largest steps."""
    p = _table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.col("p_retailprice").alias("v"))
    edges = p.select(F.col("ord").alias("i"), (F.col("ord") + 1).alias("j")).join(p.select(F.col("ord").alias("j")), "j", "left_semi").select("i", "j")
    return gis.regionalise(p, edges, ["v"], 5).select("ord", F.col("region").cast("long").alias("region"))


_SHEET = "with n as (select cast(n_nationkey as bigint) k, cast(n_regionkey as double) v from nation), q as (select 5 * b + a q, a + 4 * b c from range(4) r(a), range(4) s(b)), f as (select c as face_id, q a, q + 1 b, q + 5 c from q union all select c + 16, q + 1, q + 6, q + 5 from q) "


@query(_SHEET + ", m as (select face_id, (x.v + y.v + z.v) / 3 t from f join n x on x.k = a join n y on y.k = b join n z on z.k = c) select cast(face_id as bigint) as face_id, round(t, 9) as value, cast(1 + floor(255 * least(greatest(t / 4, 0), 1)) as integer) as colour from m")
def face_colours(spark, sf):  # noqa: ANN001, ANN201
    x = _sheet(spark, sf)
    return gis.map_faces(x.faces, x.layer(0), limits=(0.0, 4.0)).select("face_id", _r("value", 9), "colour")


@query(_SHEET + ", e as (select least(a, b) i, greatest(a, b) j from f union all select least(b, c), greatest(b, c) from f union all select least(a, c), greatest(a, c) from f) select cast(i as bigint) as i, cast(j as bigint) as j from e group by 1, 2 having count(*) = 1")
def sheet_outline(spark, sf):  # noqa: ANN001, ANN201
    return gis.outline(_sheet(spark, sf).faces)


@query("with n as (select n_nationkey v from nation) select 'a' as panel, 0 as row, 0 as col, cast(min(v) as double) as low, cast(max(2 * v) as double) as high from n union all select 'b', 0, 1, min(v), max(2 * v) from n union all select 'c', 1, 0, min(v), max(2 * v) from n")
def map_panels(spark, sf):  # noqa: ANN001, ANN201
    v = _table(spark, sf, "nation").select(F.col("n_nationkey").cast("double").alias("value"))
    return gis.layout({"a": v, "b": v.select((2 * F.col("value")).alias("value")), "c": v}, shared=True)


@query("select cast(n_nationkey as bigint) as ord, 'inside' as place, round(0.0::double, 6) as gap from nation where n_nationkey % 5 between 1 and 3 and n_nationkey // 5 between 1 and 3 union all select n_nationkey, 'rim', 0.0::double from nation where not (n_nationkey % 5 between 1 and 3 and n_nationkey // 5 between 1 and 3)")
def flattened_sheet(spark, sf):  # noqa: ANN001, ANN201
    """Inner vertices lie at the mean of their neighbours, rim vertices on the unit circle: the gap to that is none."""
    x = _sheet(spark, sf)
    at = spark.createDataFrame(gis.flatten(x.faces, 25))
    edges = topology.adjacency(x)
    near = edges.join(at.select(F.col("ord").alias("j"), F.col("x").alias("nx"), F.col("y").alias("ny")), "j").groupBy(F.col("i").alias("ord")).agg(F.avg("nx").alias("nx"), F.avg("ny").alias("ny"))
    inside = (F.col("ord") % 5).between(1, 3) & F.floor(F.col("ord") / 5).between(1, 3)
    gap = F.when(inside, F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny"))).otherwise(F.abs(F.hypot("x", "y") - 1))
    return at.join(near, "ord").select("ord", F.when(inside, "inside").otherwise("rim").alias("place"), F.abs(F.round(gap, 6)).alias("gap"))


@query("select 'area' as name, 0.25::double as value union all select 'angle', 0.5")
def chart_distortion(spark, sf):  # noqa: ANN001, ANN201
    x = _set(spark, sf)
    x = model.set_chart(x, x.elements.select("ord", "x", "y"), "flat", {"area": 0.25, "angle": 0.5})
    return spark.createDataFrame(list(model.chart_distortion(x, "flat").items()), "name string, value double")


# --- dense files, descriptions, older containers


@query("select cast(n_nationkey as bigint) as ord, cast(n_regionkey as double) as value, case when n_nationkey < 20 then 'CIFTI_STRUCTURE_CORTEX_LEFT' else 'CIFTI_STRUCTURE_THALAMUS_LEFT' end as component_id, case when n_nationkey < 20 then n_nationkey * 2 end as vertex, case when n_nationkey >= 20 then n_nationkey - 20 end as i from nation")
def dense_file(spark, sf):  # noqa: ANN001, ANN201
    path, own = _scratch(spark), sorted(tuple(r) for r in _table(spark, sf, "nation").select("n_nationkey", "n_regionkey").collect())
    data = np.array([[float(r)] for _, r in own])
    models_ = [{"type": "surface", "structure": "CIFTI_STRUCTURE_CORTEX_LEFT", "vertices": np.arange(20) * 2, "n_vertices": 64}, {"type": "voxels", "structure": "CIFTI_STRUCTURE_THALAMUS_LEFT", "voxels": np.array([[k, 1, 2] for k in range(len(own) - 20)])}]
    c = formats.Cifti(data, models_, "dscalar", ["region"], dim=(8, 8, 8), affine=np.diag([2.0, 2.0, 2.0, 1.0]))
    formats.validate_cifti(c)
    readers.atomic(f"{path}/nations.dscalar.nii", formats.write_cifti(c))
    x = readers.read(spark, f"{path}/nations.dscalar.nii")
    vertex = F.when(F.col("i").isNull(), F.col("source_index"))
    return x.layer(0).join(x.elements, "ord").select("ord", "value", "component_id", vertex.alias("vertex"), "i")


@query("select 0 as layer, 'label' as \"Name\", 'categorical' as \"ValueType\", 'categorical' as \"SpatialSemantics\", 'class' as \"Units\", 0 as issues union all select 1, 'fourth', 'continuous', 'intensive', 'unit', 0")
def derivative_sidecar(spark, sf):  # noqa: ANN001, ANN201
    x, path = _set(spark, sf), f"{_scratch(spark)}/sub-01_space-world_stat.json"
    found = provenance.sidecar(x, {"sub": "01", "space": "world"}, ["embeddings"])
    provenance.write_json(found, path)
    found = provenance.read_json(path)
    issues = provenance.validate_sidecar(found, x, path)
    rows = [(n, *(own[k] for k in provenance.SEMANTICS), len(issues)) for n, own in enumerate(found["MeasurementSemantics"])]
    return spark.createDataFrame(rows, "layer int, Name string, ValueType string, SpatialSemantics string, Units string, issues int")


@query("select cast(n_nationkey as bigint) as ord, n_name as label, cast(n_regionkey as double) as value, 'sum' as aggregation from nation")
def migrated_container(spark, sf):  # noqa: ANN001, ANN201
    rows = sorted((r["n_nationkey"], r["n_name"], r["n_regionkey"]) for r in _table(spark, sf, "nation").collect())
    old = {
        "domain": {"type": "regions", "space": {"space_id": "world"}, "elements": [{"region_id": n, "x": float(k), "y": 0.0, "z": 0.0} for k, n, _ in rows]},
        "values": [[float(r)] for *_, r in rows], "maps": [{"map_id": "m", "name": "region", "measure_id": "q"}], "measures": [{"measure_id": "q", "spatial_semantics": "extensive", "units": "one"}],
        "labels": {"names": [n for _, n, _ in rows]}, "provenance": {"by": "test"},
    }
    x = model.migrate_legacy(spark, old)
    return x.with_measures().join(x.labels["names"], "ord").select("ord", "label", "value", "aggregation")


@query(_DAYS + "select cast(count(distinct t) as integer) as points, 'day' as unit, true as fits from v")
def axis_of_days(spark, sf):  # noqa: ANN001, ANN201
    """As many points of time as there are days; weights between them pass their check."""
    n = _days(spark, sf).agg(F.countDistinct("time_ord")).first()[0]
    axis = temporal.time_axis(n=n, unit="day")
    w = temporal.temporal_weights(axis, spark, "distance", threshold=1.0)
    fits = w.groupBy("i").agg(F.sum("w").alias("s")).where(F.abs(F.col("s") - 1) > 1e-9).count() == 0 and w.where("i = j").count() == 0
    return spark.createDataFrame([(len(axis.time), axis.unit, fits)], "points int, unit string, fits boolean")


@query("select * from (values ('edges between the parts', 0), ('cells follow the sheet', 1)) t(what, n)")
def composite_parts(spark, sf):  # noqa: ANN001, ANN201
    """A sheet and a lattice in one base: ordinals run on, and no edge goes between them."""
    sheet, cells = _sheet(spark, sf), _lattice(spark, sf)
    both = model.composite({"sheet": sheet, "cells": cells})
    part = both.elements.select("ord", F.col("component_id").alias("c"))
    crossing = topology.adjacency(both).join(part.withColumnRenamed("ord", "i"), "i").join(part.select(F.col("ord").alias("j"), F.col("c").alias("d")), "j").where("c <> d").count()
    follows = int(part.where("c = 'cells'").agg(F.min("ord")).first()[0] == sheet.elements.count())
    return spark.createDataFrame([("edges between the parts", crossing), ("cells follow the sheet", follows)], "what string, n int")
