"""Registered queries on the data model, lattices, spaces, files and provenance, with their SQL."""

from __future__ import annotations

import os
import uuid
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from latticework import model
from latticework.model import Dataset, Measure, Space
from latticework.operators import spaces, support, topology
from latticework.plans import provenance
from latticework.queries import _KNN, _customers, _knn, _r, _table, query
from latticework.sources import exchange, formats, readers
from latticework.storage import shared_dir

MEASURES = (Measure("kind", "kind", "class", support_behavior="categorical"), Measure("signal", "signal", "unit", support_behavior="intensive"))


def _set(spark: SparkSession, sf: str) -> Dataset:
    """Embeddings as points by their first three components, with the label and the fourth component as layers."""
    e = _table(spark, sf, "embeddings")
    at = e.select(F.col("vec_id").alias("ord"), *[F.col("embedding")[n].cast("double").alias(c) for n, c in enumerate("xyz")])
    values = e.select(F.col("vec_id").alias("ord"), F.col("label").cast("double").alias("label"), F.col("embedding")[3].cast("double").alias("fourth"))
    return model.point(spark, at, values, measures=list(MEASURES), space=Space("world", "template", "mm"))


_V = "with e as (select vec_id as ord, cast(embedding[1] as double) x, cast(embedding[2] as double) y, cast(embedding[3] as double) z, cast(label as double) a, cast(embedding[4] as double) b from embeddings), v as (select ord, 0 as layer_ord, a as value from e union all select ord, 1, b from e) "


def _scratch(spark: SparkSession) -> str:
    """A folder of its own in the shared one, for files that are written and read again."""
    path = f"{shared_dir(spark).removeprefix('file://')}/latticework-files/{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


# --- the data model


@query(_V + "select ord, layer_ord, value from v")
def dataset_values(spark, sf):  # noqa: ANN001, ANN201
    return _set(spark, sf).values


@query("select 0 as layer_ord, 'layer_0001' as layer_id, 'label' as name, 'kind' as measure_id union all select 1, 'layer_0002', 'fourth', 'signal'")
def dataset_layers(spark, sf):  # noqa: ANN001, ANN201
    return _set(spark, sf).layers


@query("select * from (values ('kind', 'class', 'categorical', 'categorical', 'preserve', 'mode'), ('signal', 'unit', 'continuous', 'intensive', 'preserve', 'weighted_mean')) t(measure_id, unit, value_type, support_behavior, missing_policy, aggregation)")
def dataset_measures(spark, sf):  # noqa: ANN001, ANN201
    return _set(spark, sf).measures.select("measure_id", "unit", "value_type", "support_behavior", "missing_policy", "aggregation")


@query(_V + "select ord, 'element_' || lpad(cast(ord + 1 as varchar), 8, '0') as element_id, x, y, z, true as included, cast(ord as integer) as source_index from e")
def dataset_elements(spark, sf):  # noqa: ANN001, ANN201
    return _set(spark, sf).elements.select("ord", "element_id", "x", "y", "z", "included", "source_index")


@query("select * from (values ('coordinates', true), ('topology', false), ('areas', false), ('volumes', false), ('geodesic', false), ('euclidean', true), ('regions', false), ('composite', false), ('time', false), ('charts', true), ('labels', true)) t(capability, present)")
def dataset_capabilities(spark, sf):  # noqa: ANN001, ANN201
    x = model.set_chart(_set(spark, sf), _set(spark, sf).elements.select("ord", "x", "y"))
    x.labels["own"] = x.elements.select("ord", F.lit("a").alias("label"))
    return spark.createDataFrame(list(model.capabilities(x).items()), "capability string, present boolean")


@query("select * from (values (0, 'set_chart', 'point'), (1, 'subset', 'point'), (2, 'update_measure', 'point')) t(step, operation, base_type)")
def dataset_history(spark, sf):  # noqa: ANN001, ANN201
    x = _set(spark, sf)
    x = model.update_measure(model.subset(model.set_chart(x, x.elements.select("ord", "x", "y")), layers=[0]), "kind", unit="none")
    return spark.createDataFrame([(n, h["operation"], x.kind) for n, h in enumerate(provenance.export_history(x, "all"))], "step int, operation string, base_type string")


@query(_V + ", k as (select row_number() over (order by ord) - 1 as o, * from e where a >= 5) select o as ord, 0 as layer_ord, round(b, 9) as value, round(x, 9) as x from k")
def subset_elements(spark, sf):  # noqa: ANN001, ANN201
    x = _set(spark, sf)
    chosen = x.layer("label").where("value >= 5").select("ord")
    x = replace(x, elements=x.elements.join(chosen.withColumn("_in", F.lit(True)), "ord", "left"))
    found = model.subset(x, elements=F.col("_in").isNotNull(), layers=["fourth"])
    return found.values.join(found.elements.select("ord", "x"), "ord").select("ord", "layer_ord", _r("value", 9), _r("x", 9))


@query(_V + "select ord, 0 as layer_ord, b as value, 'signal' as measure_id from e")
def layer_view(spark, sf):  # noqa: ANN001, ANN201
    return model.layer_view(_set(spark, sf), "fourth").with_measures().select("ord", "layer_ord", "value", "measure_id")


@query("select * from (values ('kind', 'categorical', 'mode'), ('signal', 'extensive', 'sum')) t(measure_id, support_behavior, aggregation)")
def measure_updated(spark, sf):  # noqa: ANN001, ANN201
    return model.update_measure(_set(spark, sf), "signal", support_behavior="extensive").measures.select("measure_id", "support_behavior", "aggregation")


@query(_V + "select layer_ord, 'layer_' || lpad(cast(layer_ord + 1 as varchar), 4, '0') as layer_id, case when layer_ord < 2 then '1_' else '2_' end || case when layer_ord % 2 = 0 then 'label' else 'fourth' end as name, round(sum(value), 5) as total from (select * from v union all select ord, layer_ord + 2, value from v) group by 1")
def layers_bound(spark, sf):  # noqa: ANN001, ANN201
    both = model.bind_layers(_set(spark, sf), _set(spark, sf), conflicts="prefix")
    totals = both.values.groupBy("layer_ord").agg(F.sum("value").alias("total"))
    return both.layers.join(totals, "layer_ord").select("layer_ord", "layer_id", "name", _r("total", 5))


@query(_V + "select cast(floor(ord / 128) as integer) as block, count(*) as n, round(sum(value), 6) as total from v where layer_ord = 1 group by 1")
def blocks_of_values(spark, sf):  # noqa: ANN001, ANN201
    rows = [(n, len(b), float(round(b["value"].sum(), 6))) for n, b in enumerate(model.value_blocks(_set(spark, sf), 128, ["fourth"]))]
    return spark.createDataFrame(rows, "block int, n long, total double")


@query("select * from (values ('same rows in another order', true, true), ('other values', true, false), ('an element moved', false, false), ('another space', false, false)) t(case_, same_base, same_content)")
def identities(spark, sf):  # noqa: ANN001, ANN201
    x = _set(spark, sf)
    moved = x.elements.withColumn("x", F.when(F.col("ord") == 0, F.col("x") + 1).otherwise(F.col("x")))
    cases = {"same rows in another order": replace(x, elements=x.elements.orderBy(F.desc("ord"))), "other values": replace(x, values=x.values.withColumn("value", F.col("value") + 1)), "an element moved": replace(x, elements=moved), "another space": replace(x, space=Space("other"))}
    base, whole = model.base_signature(x), model.logical_hash(x)
    return spark.createDataFrame([(k, model.base_signature(c) == base, model.logical_hash(c) == whole) for k, c in cases.items()], "case_ string, same_base boolean, same_content boolean")


@query(_V + "select 'values are complete' as \"check\", 'strict' as level, count(*) as violations from v where value >= 5 and layer_ord = 0 union all select c, l, 0 from (values ('ordinals are unique', 'basic'), ('ordinals are contiguous from 0', 'basic'), ('element ids are unique', 'basic'), ('values have elements', 'basic'), ('values have layers', 'basic'), ('one value for an element and layer', 'basic'), ('layer ids are unique', 'basic'), ('layers have measures', 'basic'), ('coordinates are finite', 'strict'), ('supports are positive', 'strict'), ('support behaviour is known', 'scientific'), ('units are known', 'scientific'), ('space is known', 'scientific')) t(c, l)")
def contract_violations(spark, sf):  # noqa: ANN001, ANN201
    x = _set(spark, sf)
    return model.validate(replace(x, values=x.values.where("not (layer_ord = 0 and value >= 5)")), "scientific")


def _nations(spark: SparkSession, sf: str) -> Dataset:
    n = _table(spark, sf, "nation")
    return model.regions(spark, n.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("region_id"), F.lit(1.0).alias("support")))


@query("select cast(n_nationkey as bigint) as ord, n_name as region_id, 1.0::double as support, 'region' as kind from nation")
def regions_base(spark, sf):  # noqa: ANN001, ANN201
    x = _nations(spark, sf)
    return topology.support_size(x).join(x.elements.select("ord", "region_id"), "ord").select("ord", "region_id", "support", F.lit(x.kind).alias("kind"))


@query("select cast(least(n_nationkey, (7 * n_nationkey + 3) % 25) as bigint) as from_ord, cast(greatest(n_nationkey, (7 * n_nationkey + 3) % 25) as bigint) as to_ord, cast(n_regionkey as double) as value, true as valid from nation")
def relation_pairs(spark, sf):  # noqa: ANN001, ANN201
    x = _nations(spark, sf)
    k = F.col("n_nationkey").cast("long")
    pairs = _table(spark, sf, "nation").select(k.alias("from_ord"), ((7 * k + 3) % 25).alias("to_ord"), F.col("n_regionkey").cast("double").alias("value"))
    found = model.relation(x, pairs, "traffic")
    return found.data.withColumn("valid", F.lit(model.validate_relation(found, x)))


@query(_V + "select ord, 'POINT (' || cast(floor(x * 10) as varchar) || ' ' || cast(floor(y * 10) as varchar) || ')' as geometry from e")
def planar_points(spark, sf):  # noqa: ANN001, ANN201
    x = _set(spark, sf)
    x = replace(x, elements=x.elements.withColumns({c: F.floor(F.col(c) * 10).cast("double") + 0.0 for c in "xy"}))
    return model.planar_features(x)


@query(_V + "select ord, x, y, 'chart' as role from e")
def chart_coordinates(spark, sf):  # noqa: ANN001, ANN201
    x = _set(spark, sf)
    x = model.set_chart(x, x.elements.select("ord", "x", "y"), "flat")
    return x.coordinates["flat"].withColumn("role", F.lit(x.roles["flat"]))


@query(_KNN + "select i, string_agg(cast(j as varchar), ',' order by j) as neighbours, round(sum(w), 9) as total from w group by 1")
def neighbour_lists(spark, sf):  # noqa: ANN001, ANN201
    found = topology.neighbour_lists(_knn(spark, sf))
    return found.select("i", F.array_join(F.transform("neighbours", lambda j: j.cast("string")), ",").alias("neighbours"), F.round(F.aggregate("weights", F.lit(0.0), lambda s, w: s + w), 9).alias("total"))


@query(_V + "select ord, cast(cast(a as integer) as varchar) as region_id from e where a <> 0")
def partition_of_points(spark, sf):  # noqa: ANN001, ANN201
    x = _set(spark, sf)
    return topology.partition(x, x.layer("label").select("ord", F.col("value").cast("int").alias("label")), background="0")


@query(_V + ", r as (select cast(cast(a as integer) as varchar) region_id, avg(x) x, avg(y) y, count(*) n, avg(b) b from e group by a) select row_number() over (order by region_id) - 1 as ord, region_id, round(x, 8) as x, round(y, 8) as y, cast(n as double) as support, round(b, 8) as value from r")
def aggregate_by_region(spark, sf):  # noqa: ANN001, ANN201
    x = _set(spark, sf)
    found = support.aggregate_regions(model.layer_view(x, "fourth"), topology.partition(x, x.layer("label").select("ord", F.col("value").cast("int").alias("label"))))
    return found.values.join(found.elements, "ord").select("ord", "region_id", _r("x", 8), _r("y", 8), "support", _r("value", 8))


@query(_V + "select s.ord as source, t.ord as target, round(sqrt((s.x-t.x)*(s.x-t.x)+(s.y-t.y)*(s.y-t.y)+(s.z-t.z)*(s.z-t.z)), 9) as distance from e s, e t where s.ord < 5 and t.ord % 10 = 0")
def distances(spark, sf):  # noqa: ANN001, ANN201
    x = _set(spark, sf)
    ords = x.elements.select("ord")
    return topology.distance(x, ords.where("ord < 5"), ords.where("ord % 10 = 0")).select("source", "target", _r("distance", 9))


@query(_V + "select 'constant_layers' as \"check\", 'warning' as status, 1 as n union all select 'nonfinite_values', 'pass', 0 union all select 'missing_values', 'warning', count(*) from e where a >= 5 union all select 'unknown_semantics', 'pass', 0 union all select 'overall', 'warning', null")
def quality_figures(spark, sf):  # noqa: ANN001, ANN201
    x = _set(spark, sf)
    v = x.values.where("not (layer_ord = 0 and value >= 5)").withColumn("value", F.when(F.col("layer_ord") == 1, 3.0).otherwise(F.col("value")))
    return topology.quality_report(replace(x, values=v))


@query(_V + "select ord, round(x, 9) as x, round(z, 9) as y, round(atan2(y, x), 8) as lon, round(asin(z / sqrt(x*x+y*y+z*z)), 8) as lat from e")
def surface_views(spark, sf):  # noqa: ANN001, ANN201
    from latticework.operators import gis

    at = _set(spark, sf).elements
    ball = gis.view(at, "spherical").select("ord", F.col("x").alias("lon"), F.col("y").alias("lat"))
    return gis.view(at, "orthographic", "xz").join(ball, "ord").select("ord", _r("x", 9), _r("y", 9), _r("lon", 8), _r("lat", 8))


# --- a lattice: sizes and brands of parts as occupied cells


AFFINE = ((2.0, 0.0, 0.0, -10.0), (0.0, 3.0, 0.0, 5.0), (0.0, 0.0, 4.0, 0.0), (0.0, 0.0, 0.0, 1.0))


def _lattice(spark: SparkSession, sf: str) -> Dataset:
    """50 x 60 x 1 cells, those occupied that have a part; the value is the number of parts."""
    p = _table(spark, sf, "part")
    cells = p.groupBy(((F.col("p_size") - 1) + 50 * F.regexp_extract("p_brand", r"([0-9]+)", 1).cast("int")).cast("long").alias("source_index")).agg(F.count("*").cast("double").alias("value"))
    x = model.volume(spark, (50, 60, 1), AFFINE, cells.select("source_index"))
    values = x.elements.select("ord", F.col("source_index").cast("long").alias("source_index")).join(cells, "source_index").select("ord", F.lit(0).alias("layer_ord"), "value")
    return model.make(spark, "volume", x.elements, values, ["parts"], Measure("parts", "parts", "count", support_behavior="count"), affine=x.affine, dim=x.dim, space=Space("cells", "lattice", "mm"))


_L = "with recursive c as (select (p_size - 1) + 50 * cast(regexp_extract(p_brand, '([0-9]+)', 1) as integer) s, cast(count(*) as double) n from part group by 1), l as (select row_number() over (order by s) - 1 as ord, s, s % 50 as i, s // 50 as j, n from c), q as (select a.ord i, b.ord j from l a join l b on abs(a.i - b.i) + abs(a.j - b.j) = 1) "


@query(_L + "select ord, s as source_index, i, j, 0 as k, -10 + 2.0 * i as x, 5 + 3.0 * j as y, 0.0 as z from l".replace("2.0 * i", "2.0::double * i").replace("3.0 * j", "3.0::double * j").replace("0.0 as z", "0.0::double as z"))
def lattice_elements(spark, sf):  # noqa: ANN001, ANN201
    return _lattice(spark, sf).elements.select("ord", "source_index", "i", "j", "k", "x", "y", "z")


@query(_L + "select ord, 24.0::double as support from l")
def lattice_support(spark, sf):  # noqa: ANN001, ANN201
    return topology.support_size(_lattice(spark, sf)).select("ord", F.round("support", 9).alias("support"))


@query(_L + "select i, j from q")
def lattice_adjacency(spark, sf):  # noqa: ANN001, ANN201
    return topology.adjacency(_lattice(spark, sf)).select("i", "j")


@query(_L + ", r as (select ord as a, ord as b from l union select r.a, q.j from r join q on q.i = r.b) select a as ord, min(b) as root from r group by 1")
def lattice_components(spark, sf):  # noqa: ANN001, ANN201
    return topology.connected(_lattice(spark, sf)).select("ord", "root")


@query(_L + ", r as (select 0 as o, 0 as d union select q.j, r.d + 1 from r join q on q.i = r.o where r.d < 12) select cast(0 as bigint) as source, cast(o as bigint) as target, cast(min(d) as double) as distance from r group by o")
def lattice_steps(spark, sf):  # noqa: ANN001, ANN201
    x = _lattice(spark, sf)
    return topology.distance(x, x.elements.where("ord = 0").select("ord"), method="hops", most=12).select("source", "target", "distance")


@query(_L + "select i, j, round(1.0 / count(*) over (partition by i), 9) as w from q")
def lattice_weights(spark, sf):  # noqa: ANN001, ANN201
    return topology.weights(_lattice(spark, sf), "contiguity", "W").select("i", "j", _r("w", 9))


@query(_V + ", n as (select a.ord i, b.ord j, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) d from e a join e b on a.ord <> b.ord) select i, j, round(power(d, -2.0), 4) as w_raw from n where d <= 0.08")
def weights_by_distance(spark, sf):  # noqa: ANN001, ANN201
    return topology.weights(_set(spark, sf), "inverse_distance", "none", threshold=0.08, power=2.0).select("i", "j", _r("w_raw", 4))


@query(_L + "select cast((i // 5) + 10 * (j // 6) as bigint) as target_ord, cast(ord as bigint) as source_ord, 1.0::double as weight from l")
def lattice_nearest_map(spark, sf):  # noqa: ANN001, ANN201
    """Cells to the coarser cell whose centre is nearest: 5 x 6 cells make one."""
    fine = _lattice(spark, sf)
    coarse = model.volume(spark, (10, 10, 1), [[10, 0, 0, -6], [0, 18, 0, 12.3], [0, 0, 4, 0], [0, 0, 0, 1]])
    return support.affine_grid_map(fine, coarse).weights.select("target_ord", "source_ord", "weight")


@query(_L + ", t as (select ord, i, j, n, -0.5 + 0.5 * i u from l), p as (select ord, j, n, floor(u) f, u - floor(u) r from t), w as (select f + 0 t, ord, j, 1 - r w from p union all select f + 1, ord, j, r from p) select cast(t + 26 * j as bigint) as target_ord, cast(ord as bigint) as source_ord, cast(w as double) as weight from w where w > 0 and t between 0 and 25")
def lattice_trilinear_map(spark, sf):  # noqa: ANN001, ANN201
    fine = _lattice(spark, sf)
    coarse = model.volume(spark, (26, 60, 1), [[4, 0, 0, -8], [0, 3, 0, 5], [0, 0, 4, 0], [0, 0, 0, 1]])
    return support.affine_grid_map(fine, coarse, "trilinear", "drop").weights.select("target_ord", "source_ord", "weight")


@query(_L + ", w as (select ord, j, (2 * i) // 3 t, i, 1 as k from l union all select ord, j, (2 * i + 1) // 3, i, 2 from l), s as (select ord, j, t, count(*) * 0.5::double w from w group by ord, j, t) select cast(t + 34 * j as bigint) as target_ord, cast(ord as bigint) as source_ord, round(w, 9) as weight from s")
def lattice_overlap_map(spark, sf):  # noqa: ANN001, ANN201
    """Cells of 2 mm on cells of 3 mm: halves of a cell fall into one of them."""
    fine = _lattice(spark, sf)
    coarse = model.volume(spark, (34, 60, 1), [[3, 0, 0, -9.5], [0, 3, 0, 5], [0, 0, 4, 0], [0, 0, 0, 1]])
    return support.voxel_overlap_map(fine, coarse).weights.select("target_ord", "source_ord", _r("weight", 9))


@query(_L + "select cast((i // 5) + 10 * (j // 6) as bigint) as ord, 0 as layer_ord, sum(n) as value, 'count' as support_behavior from l group by 1")
def lattice_resampled(spark, sf):  # noqa: ANN001, ANN201
    coarse = model.volume(spark, (10, 10, 1), [[10, 0, 0, -6], [0, 18, 0, 12.3], [0, 0, 4, 0], [0, 0, 0, 1]])
    found = support.ResamplingPlan("nearest").resample(_lattice(spark, sf), coarse, authorize=True)
    return found.with_measures().select("ord", "layer_ord", "value", "support_behavior")


# --- spaces and transforms


@query("select * from (values ('space_id', 'different'), ('kind', 'same'), ('unit', 'incompatible'), ('dimension', 'same'), ('structure', 'same'), ('template', 'different'), ('density', 'same'), ('resolution', 'same'), ('own hash', 'same'), ('other hash', 'different')) t(field, status)")
def space_audit(spark, sf):  # noqa: ANN001, ANN201
    a, b = Space("a", "template", "mm", template="t1"), Space("b", "template", "voxel", template="t2")
    rows = [*spaces.audit(a, b).items(), ("own hash", "same" if spaces.space_hash(a) == spaces.space_hash(replace(a)) else "different"), ("other hash", "same" if spaces.space_hash(a) == spaces.space_hash(b) else "different")]
    return spark.createDataFrame(rows, "field string, status string")


def _moves() -> tuple[Space, Space, Space, spaces.Transform, spaces.Transform]:
    a, b, c = Space("world", "template", "mm"), Space("other", "template", "mm"), Space("third", "template", "mm")
    first = spaces.Transform(a, b, "affine", ((2, 0, 0, 1), (0, 3, 0, -2), (0, 0, 4, 0.5), (0, 0, 0, 1)))
    second = spaces.Transform(b, c, "affine", ((0, 1, 0, 0), (1, 0, 0, 0), (0, 0, 1, 7), (0, 0, 0, 1)))
    return a, b, c, first, second


@query("select * from (values ('alias', 'other'), ('hash', 'other'), ('id', 'third'), ('object', 'world')) t(by_, space_id)")
def space_registry(spark, sf):  # noqa: ANN001, ANN201
    a, b, c, *_ = _moves()
    r = spaces.Registry().register(a).register(b, ("second",)).register(c)
    return spark.createDataFrame([("alias", r.resolve("second").space_id), ("hash", r.resolve(spaces.space_hash(b)).space_id), ("id", r.resolve("third").space_id), ("object", r.resolve(a).space_id)], "by_ string, space_id string")


@query(_V + "select ord, round(2 * x + 1, 8) as x, round(3 * y - 2, 8) as y, round(4 * z + 0.5, 8) as z, 'other' as space_id from e")
def transformed(spark, sf):  # noqa: ANN001, ANN201
    found = spaces.apply(_set(spark, sf), _moves()[3])
    return found.elements.select("ord", _r("x", 8), _r("y", 8), _r("z", 8), F.lit(found.space.space_id).alias("space_id"))


@query(_V + "select ord, round(3 * y - 2, 8) as x, round(2 * x + 1, 8) as y, round(4 * z + 7.5, 8) as z, 'third' as space_id from e")
def transform_path(spark, sf):  # noqa: ANN001, ANN201
    a, b, c, first, second = _moves()
    g = spaces.TransformGraph(spaces.Registry().register(a).register(b).register(c)).add(first, "one").add(second, "two")
    found = spaces.apply_path(_set(spark, sf), g, g.path(a, c), authorize=True)
    return found.elements.select("ord", _r("x", 8), _r("y", 8), _r("z", 8), F.lit(found.space.space_id).alias("space_id"))


@query(_V + "select ord, round(x, 7) as x, round(y, 7) as y, round(z, 7) as z from e")
def transform_inverted(spark, sf):  # noqa: ANN001, ANN201
    _, _, _, first, second = _moves()
    there = first.then(second)
    return spaces.apply(spaces.apply(_set(spark, sf), there), there.invert()).elements.select("ord", _r("x", 7), _r("y", 7), _r("z", 7))


@query("select * from (values ('cycles', 'one|back'), ('ambiguous', 'one|also')) t(what, edges)")
def transform_diagnostics(spark, sf):  # noqa: ANN001, ANN201
    a, b, c, first, second = _moves()
    g = spaces.TransformGraph(spaces.Registry().register(a).register(b).register(c)).add(first, "one").add(first.invert(), "back").add(second, "two")
    g = g.add(spaces.Transform(a, b, "affine", ((1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1))), "also")
    found = g.diagnostics()
    rows = [(k, "|".join(p)) for k in ("cycles", "ambiguous") for p in found[k] if "one" in p]
    return spark.createDataFrame(rows, "what string, edges string")


# --- files that are written and read again


@query(_L + "select ord, 0 as layer_ord, n as value, s as source_index, 2.0::double * i - 10 as x from l")
def volume_file(spark, sf):  # noqa: ANN001, ANN201
    x, path = _lattice(spark, sf), _scratch(spark)
    readers.write(x, f"{path}/parts.nii.gz")
    mask = formats.read_nifti(readers.raw_bytes(spark, f"{path}/parts_mask.nii")).data[..., 0] > 0
    found = readers.read(spark, f"{path}/parts.nii.gz", mask=mask)
    return found.values.join(found.elements, "ord").select("ord", "layer_ord", "value", "source_index", "x")


@query(_L + "select s as source_index, 0 as frame, n as value from l")
def volume_values(spark, sf):  # noqa: ANN001, ANN201
    path = _scratch(spark)
    readers.write_image(_lattice(spark, sf), f"{path}/parts.mgz")
    return readers.image_values(spark, f"{path}/parts.mgz").where("value <> 0").select(F.col("source_index").cast("int").alias("source_index"), "frame", "value")


def _sheet(spark: SparkSession, sf: str) -> Dataset:
    """Nations on a flat 5 x 5 grid of vertices, two triangles a cell; the value is the region."""
    n = _table(spark, sf, "nation")
    k = F.col("n_nationkey")
    at = n.select(k.cast("long").alias("ord"), (k % 5).cast("double").alias("x"), F.floor(k / 5).cast("double").alias("y"), F.lit(0.0).alias("z"))
    faces = [(c, q, q + 1, q + 5) for c, q in enumerate(5 * b + a for b in range(4) for a in range(4))]
    faces += [(c + 16, q + 1, q + 6, q + 5) for c, q, *_ in faces]
    return model.surface(spark, at, spark.createDataFrame(faces, "face_id long, v1 long, v2 long, v3 long"), n.select(k.cast("long").alias("ord"), F.col("n_regionkey").cast("double").alias("region")), measures=Measure("region", support_behavior="categorical"))


@query("select cast(n_nationkey as bigint) as ord, cast(n_regionkey as double) as value, cast(n_nationkey % 5 as double) as x, cast(n_nationkey // 5 as double) as y from nation")
def surface_file(spark, sf):  # noqa: ANN001, ANN201
    x, path = _sheet(spark, sf), _scratch(spark)
    readers.write_gifti(x, f"{path}/sheet.surf.gii")
    found = readers.read_gifti(spark, f"{path}/sheet.surf.gii", f"{path}/sheet.surf.gii")
    return found.values.join(found.elements, "ord").select("ord", "value", "x", "y")


@query("select cast(n_nationkey as bigint) as ord, cast(n_regionkey as double) as value, 'region ' || n_regionkey as label from nation")
def reconstruction_file(spark, sf):  # noqa: ANN001, ANN201
    x, path = _sheet(spark, sf), _scratch(spark)
    at = x.elements.orderBy("ord").toPandas()[["x", "y", "z"]].to_numpy()
    own = x.layer(0).orderBy("ord").toPandas()["value"].to_numpy()
    readers.atomic(f"{path}/lh.white", formats.write_surface(at, x.faces.orderBy("face_id").toPandas()[["v1", "v2", "v3"]].to_numpy()))
    readers.atomic(f"{path}/lh.region", formats.write_curv(own))
    readers.atomic(f"{path}/lh.annot", formats.write_annot(own.astype(int) + 1, {k + 1: (f"region {k}", (k + 1, 0, 0, 0)) for k in range(5)}))
    found = readers.read_freesurfer(spark, f"{path}/lh.white", f"{path}/lh.region", f"{path}/lh.annot")
    return found.layer(0).join(found.labels["annot"], "ord").select("ord", "value", "label")


@query(_V + "select ord, 0 as layer_ord, round(2 * b + 1, 9) as value from e")
def raw_matrix(spark, sf):  # noqa: ANN001, ANN201
    path, x = _scratch(spark), _set(spark, sf)
    table = x.values.groupBy("ord").pivot("layer_ord", [0, 1]).agg(F.first("value")).orderBy("ord").toPandas()
    readers.atomic(f"{path}/values.raw", table[["0", "1"]].to_numpy(dtype="<f8").tobytes())
    readers.copy_raw(f"{path}/values.raw", f"{path}/copy.raw")
    return readers.raw_values(spark, f"{path}/copy.raw", len(table), 2, frames=[1], slope=2, intercept=1, block=100, size=len(table) * 16).select("ord", "layer_ord", _r("value", 9))


@query("select cast(c_nationkey as bigint) as target_ord, c_custkey as source_ord, 1.0::double as weight from customer")
def map_file(spark, sf):  # noqa: ANN001, ANN201
    _, m = _customers(spark, sf)
    path = _scratch(spark)
    exchange.write_map(m["nation"], f"{path}/nation")
    exchange.migrate(spark, f"{path}/nation", f"{path}/bundle", chunk=100)
    exchange.validate_bundle(f"{path}/bundle")
    return exchange.read_map(spark, f"{path}/bundle").weights.select("target_ord", "source_ord", "weight")


@query("select c_custkey as source_ord, 1.0::double as support, 'crisp' as kind, 'complete' as coverage from customer")
def map_bundle(spark, sf):  # noqa: ANN001, ANN201
    _, m = _customers(spark, sf)
    path = f"{_scratch(spark)}/bundle"
    exchange.write_bundle(m["nation"], path)
    found = exchange.read_bundle(spark, path)
    return found.support.select("source_ord", "support", F.lit(found.kind).alias("kind"), F.lit(found.coverage).alias("coverage"))


# --- provenance


@query("select * from (values ('sub', '01'), ('ses', 'b'), ('space', 'x'), ('suffix', 'bold'), ('extension', '.nii.gz'), ('name', 'sub-01_ses-b_space-x_bold.nii.gz')) t(part, value)")
def name_parts(spark, sf):  # noqa: ANN001, ANN201
    found = provenance.parse_name("/data/sub-01_ses-b_space-x_bold.nii.gz")
    rows = [*found["entities"].items(), ("suffix", found["suffix"]), ("extension", found["extension"]), ("name", provenance.build_name(found["entities"], found["suffix"], found["extension"]))]
    return spark.createDataFrame(rows, "part string, value string")


@query("select n_name as node, row_number() over (order by n_regionkey, n_name) - 1 as place from (select n_name, n_regionkey from nation)")
def history_order(spark, sf):  # noqa: ANN001, ANN201
    """Nations after all those of the region before: the order that the graph leaves, names breaking ties."""
    rows = _table(spark, sf, "nation").collect()
    edges = [(a["n_name"], b["n_name"]) for a in rows for b in rows if b["n_regionkey"] == a["n_regionkey"] + 1]
    dag = provenance.history_dag([r["n_name"] for r in rows], edges)
    provenance.validate_dag(dag)
    return spark.createDataFrame([(n, k) for k, n in enumerate(dag["nodes"])], "node string, place long")


@query(_V + "select row_number() over (order by ord) - 1 as ord, 0 as layer_ord, round(b, 9) as value from e where ord < 50")
def replayed(spark, sf):  # noqa: ANN001, ANN201
    x = {"x": _set(spark, sf)}
    steps = [provenance.Step("some", "subset", "x", {"elements": list(range(50))}), provenance.Step("one", "subset", "some", {"layers": ["fourth"]})]
    manifest, _ = provenance.record(x, steps)
    return provenance.replay(manifest, x)["one"].values.select("ord", "layer_ord", _r("value", 9))


@query("select n_name || '.txt' as path, 'data' as role, cast(length(n_name) as bigint) as size, sha256(n_name) as sha256 from nation where n_regionkey = 1")
def artifact_batch(spark, sf):  # noqa: ANN001, ANN201
    names = [r[0] for r in _table(spark, sf, "nation").where("n_regionkey = 1").select("n_name").collect()]

    def writer(text: str):  # noqa: ANN202
        return lambda path: readers.atomic(path, text.encode())

    path = f"{_scratch(spark)}/batch"
    provenance.write_batch(path, {f"{n}.txt": writer(n) for n in names})
    return spark.createDataFrame([(e["path"], e["role"], e["size"], e["sha256"]) for e in provenance.read_batch(path)["entries"]], "path string, role string, size long, sha256 string")


@query("select * from (values ('manifest', 0), ('manifest of other data', 1), ('changed manifest', 1), ('sidecar', 0), ('sidecar of another base', 1)) t(what, issues)")
def manifest_issues(spark, sf):  # noqa: ANN001, ANN201
    x = _set(spark, sf)
    other = replace(x, values=x.values.withColumn("value", F.col("value") + 1))
    path = f"{_scratch(spark)}/manifest.json"
    provenance.write_json(provenance.object_manifest(x), path)
    m, beside = provenance.read_json(path), provenance.sidecar(x)
    far = replace(x, space=Space("other"))
    rows = [("manifest", provenance.validate_manifest(m, x)), ("manifest of other data", provenance.validate_manifest(m, other)), ("changed manifest", provenance.validate_manifest({**m, "kind": "other"}, x)), ("sidecar", provenance.validate_sidecar(beside, x)), ("sidecar of another base", provenance.validate_sidecar(beside, far))]
    return spark.createDataFrame([(k, len(v)) for k, v in rows], "what string, issues int")


@query("select 'tetrahedron' as name, cast(o as bigint) as ord, v::double as value from (values (0, 10), (1, 20), (2, 30), (3, 40)) t(o, v) union all select 'voxels', cast(o as bigint), v::double from (values (0, 1), (1, 2), (2, 5), (3, 14)) t(o, v)")
def example_values(spark, sf):  # noqa: ANN001, ANN201
    from latticework.sources import examples

    known = examples.manifest()
    parts = [examples.load(spark, n, known[n]).values.select(F.lit(n).alias("name"), "ord", "value") for n in ("tetrahedron", "voxels")]
    return parts[0].unionByName(parts[1])
