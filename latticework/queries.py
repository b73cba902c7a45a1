"""Registered queries: the operators on the driver's tables, each with the SQL that gives the same rows.

The tables hold no geometry, so a part or a customer is an element, its brand,
nation or segment a region, two components of an embedding are coordinates, and
days are points of time. Every query runs over its whole tables. Results are
rounded alike on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators import gis, inference, models, multilayer, statistics, support, temporal, topology

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]):  # noqa: ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(c: str, digits: int = 6):  # noqa: ANN202
    return F.round(c, digits).alias(c)


# --- change of support: parts to brands, customers to nations, segments and regions


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, support.SupportMap]:
    """Parts with sold quantity as support; values (ord, layer_ord, value); map to brands by number."""
    sold = _table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("support"), F.sum("l_extendedprice").alias("money"))
    parts = _table(spark, sf, "part").join(sold, F.col("p_partkey") == F.col("l_partkey"))
    brand = F.regexp_extract("p_brand", r"([0-9]+)", 1).cast("long")
    weights = parts.select(brand.alias("target_ord"), F.col("p_partkey").alias("source_ord"), F.lit(1.0).alias("weight"))
    m = support.SupportMap(weights, parts.select(F.col("p_partkey").alias("source_ord"), "support"))
    return parts, parts.select(F.col("p_partkey").alias("ord"), "p_retailprice", "p_size", "money"), m


def _layer(values: DataFrame, column: str) -> DataFrame:
    return values.select("ord", F.lit(0).alias("layer_ord"), F.col(column).cast("double").alias("value"))


_PARTS = "with s as (select l_partkey, sum(l_quantity) q, sum(l_extendedprice) m from lineitem group by 1), p as (select cast(regexp_extract(p_brand, '([0-9]+)', 1) as bigint) t, p_partkey, p_retailprice v, cast(p_size as double) c, q, m from part join s on p_partkey = l_partkey) "


@query(_PARTS + "select t as target_ord, round(sum(q * v) / sum(q), 6) as value from p group by 1")
def support_intensive(spark, sf):  # noqa: ANN001, ANN201
    _, v, m = _parts(spark, sf)
    return support.aggregate(_layer(v, "p_retailprice"), m, "intensive").select("target_ord", _r("value"))


@query(_PARTS + "select t as target_ord, round(sum(m), 2) as value from p group by 1")
def support_extensive(spark, sf):  # noqa: ANN001, ANN201
    _, v, m = _parts(spark, sf)
    return support.aggregate(_layer(v, "money"), m, "extensive").select("target_ord", _r("value", 2))


@query(_PARTS + "select target_ord, value from (select t as target_ord, c as value, row_number() over (partition by t order by sum(q) desc, c) rn from p group by t, c) where rn = 1")
def support_categorical(spark, sf):  # noqa: ANN001, ANN201
    _, v, m = _parts(spark, sf)
    return support.aggregate(_layer(v, "p_size"), m, "categorical").select("target_ord", "value")


@query(_PARTS + "select t as target_ord, round(sum(q * q * 0.01 * v * v) / (sum(q) * sum(q)), 6) as variance from p group by 1")
def support_variance(spark, sf):  # noqa: ANN001, ANN201
    _, v, m = _parts(spark, sf)
    values = _layer(v, "p_retailprice")
    variances = values.select("ord", "layer_ord", (0.01 * F.col("value") ** 2).alias("variance"))
    return support.variance(values, variances, m, "intensive").select("target_ord", _r("variance"))


def _customers(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, support.SupportMap]]:
    c = _table(spark, sf, "customer")
    own = c.select(F.col("c_custkey").alias("source_ord"), F.lit(1.0).alias("support"))
    nation = c.select(F.col("c_nationkey").cast("long").alias("target_ord"), F.col("c_custkey").alias("source_ord"), F.lit(1.0).alias("weight"))
    segment = c.select((F.ascii("c_mktsegment")).cast("long").alias("target_ord"), F.col("c_custkey").alias("source_ord"), F.lit(1.0).alias("weight"))
    n = _table(spark, sf, "nation")
    up = support.SupportMap(n.select(F.col("n_regionkey").cast("long").alias("target_ord"), F.col("n_nationkey").cast("long").alias("source_ord"), F.lit(1.0).alias("weight")), n.select(F.col("n_nationkey").cast("long").alias("source_ord"), F.lit(1.0).alias("support")))
    return c.select(F.col("c_custkey").alias("ord"), F.col("c_acctbal").alias("value")), {"nation": support.SupportMap(nation, own), "segment": support.SupportMap(segment, own), "up": up}


@query("select cast(n_regionkey as bigint) as target_ord, round(sum(c_acctbal), 2) as value from customer join nation on c_nationkey = n_nationkey group by 1")
def support_composed(spark, sf):  # noqa: ANN001, ANN201
    v, m = _customers(spark, sf)
    both = support.compose(m["nation"], m["up"])
    return support.aggregate(_layer(v, "value"), both, "extensive").select("target_ord", _r("value", 2))


_PAIRS = "with b as (select cast(c_nationkey as bigint) f, cast(ascii(c_mktsegment) as bigint) s, count(*) n from customer group by 1, 2), bf as (select f, sum(n) nf from b group by 1), bs as (select s, sum(n) ns from b group by 1) "


@query(_PAIRS + "select f as first_ord, s as second_ord, cast(n as double) as value from b")
def atlas_intersection(spark, sf):  # noqa: ANN001, ANN201
    _, m = _customers(spark, sf)
    return support.atlas_overlap(m["nation"], m["segment"])


@query(_PAIRS + "select f as first_ord, s as second_ord, round(n / (nf + ns - n), 9) as value from b join bf using (f) join bs using (s)")
def atlas_jaccard(spark, sf):  # noqa: ANN001, ANN201
    _, m = _customers(spark, sf)
    return support.atlas_overlap(m["nation"], m["segment"], "jaccard").select("first_ord", "second_ord", _r("value", 9))


@query(_PAIRS + "select first_ord, second_ord, dice from (select f as first_ord, s as second_ord, round(2.0 * n / (nf + ns), 9) as dice, row_number() over (partition by f order by 2.0 * n / (nf + ns) desc, s) rn from b join bf using (f) join bs using (s)) where rn = 1")
def atlas_best_match(spark, sf):  # noqa: ANN001, ANN201
    _, m = _customers(spark, sf)
    return support.atlas_compare(m["nation"], m["segment"]).select("first_ord", "second_ord", _r("dice", 9))


@query(_PAIRS + ", v as (select cast(c_nationkey as bigint) f, avg(c_acctbal) a from customer group by 1) select s as ord, round(sum(n * a) / sum(n), 6) as value from b join v using (f) group by 1")
def atlas_transfer(spark, sf):  # noqa: ANN001, ANN201
    v, m = _customers(spark, sf)
    means = support.aggregate(_layer(v, "value"), m["nation"], "intensive").select(F.col("target_ord").alias("ord"), "value")
    return support.cross_atlas(means, m["nation"], m["segment"]).select("ord", _r("value"))


def _shares(spark: SparkSession, sf: str) -> support.SupportMap:
    """Parts shared among their suppliers by quantity."""
    li = _table(spark, sf, "lineitem")
    q = li.groupBy(F.col("l_suppkey").alias("target_ord"), F.col("l_partkey").alias("source_ord")).agg(F.sum("l_quantity").alias("q"))
    total = q.groupBy("source_ord").agg(F.sum("q").alias("support"))
    return support.SupportMap(q.join(total, "source_ord").select("target_ord", "source_ord", (F.col("q") / F.col("support")).alias("weight")), total, "probabilistic")


_SHARES = "with q as (select l_suppkey t, l_partkey s, sum(l_quantity) q from lineitem group by 1, 2), p as (select t, s, q / sum(q) over (partition by s) w, sum(q) over (partition by s) total from q) "


@query(_SHARES + "select s as source_ord, round(sum(-w * ln(w)) / ln((select count(distinct t) from q)), 9) as entropy from p group by 1")
def support_entropy(spark, sf):  # noqa: ANN001, ANN201
    return support.entropy(_shares(spark, sf)).select("source_ord", (F.round("entropy", 9) + 0.0).alias("entropy"))


@query(_SHARES + "select t as target_ord, round(sum(w * total), 4) as support from p group by 1")
def support_of_targets(spark, sf):  # noqa: ANN001, ANN201
    return _shares(spark, sf).target_support().select("target_ord", _r("support", 4))


@query(_SHARES + ", f as (select s, sum(w) sw, count(*) n, max(total) total from p group by 1) select 'sources' as name, cast(count(*) as double) as value from f union all select 'conserved_sources', cast(count(*) filter (where abs(sw - 1) <= 1e-10) as double) from f union all select 'most_targets', cast(max(n) as double) from f union all select 'mean_targets', round(avg(n), 6) from f union all select 'entries', cast(count(*) as double) from p union all select 'source_support', round(sum(total), 3) from f")
def support_diagnostics(spark, sf):  # noqa: ANN001, ANN201
    found = support.diagnostics(_shares(spark, sf)).where(F.col("name").isin("sources", "conserved_sources", "most_targets", "mean_targets", "entries", "source_support"))
    return found.select("name", F.when(F.col("name") == "source_support", F.round("value", 3)).otherwise(F.round("value", 6)).alias("value"))


@query("select rule, count(*) as n from (select 'crisp' as rule from (select l_partkey, count(distinct l_suppkey) n from lineitem group by 1) where n > 1) group by 1")
def support_violations(spark, sf):  # noqa: ANN001, ANN201
    m = _shares(spark, sf)
    return support.violations(support.SupportMap(m.weights, m.support, "crisp", "partial")).where("rule = 'crisp'").groupBy("rule").agg(F.count("*").alias("n"))


@query("select 'nation' as support, count(distinct c_nationkey) as n, round(avg_v, 6) as value from customer, (select avg(c_acctbal) avg_v from customer) group by 3 union all select 'segment', count(distinct c_mktsegment), round(avg_v, 6) from customer, (select avg(c_acctbal) avg_v from customer) group by 3")
def support_invariance(spark, sf):  # noqa: ANN001, ANN201
    v, m = _customers(spark, sf)
    maps = {k: m[k] for k in ("nation", "segment")}
    counts = None
    for k, one in maps.items():
        row = one.weights.agg(F.lit(k).alias("support"), F.countDistinct("target_ord").alias("n"))
        counts = row if counts is None else counts.unionByName(row)
    return inference.invariance(v, maps).join(counts, "support").select("support", "n", _r("value"))


@query("with v as (select c_custkey, c_acctbal y, cast(c_custkey % 97 as double) x, c_nationkey, c_mktsegment from customer), a as (select avg(y) y, avg(x) x from v group by c_nationkey), b as (select avg(y) y, avg(x) x from v group by c_mktsegment) select 'nation' as support, count(*) as n, round(corr(y, x), 8) as effect from a union all select 'segment', count(*), round(corr(y, x), 8) from b")
def support_effects(spark, sf):  # noqa: ANN001, ANN201
    v, m = _customers(spark, sf)
    x = v.select("ord", (F.col("ord") % 97).cast("double").alias("value"))
    return inference.region_effects(v, x, {k: m[k] for k in ("nation", "segment")}).select("support", "n", _r("effect", 8))


@query("with v as (select c_acctbal y, cast(c_custkey % 97 as double) x, c_nationkey g from customer), a as (select avg(y) y, avg(x) x, count(*) s from v group by g), t as (select sum(s) s, sum(s*x) x, sum(s*y) y, sum(s*x*x) xx, sum(s*x*y) xy from a) select 'nation' as support, round((xy - x*y/s) / (xx - x*x/s), 6) as slope from t")
def support_slope(spark, sf):  # noqa: ANN001, ANN201
    v, m = _customers(spark, sf)
    x = v.select("ord", (F.col("ord") % 97).cast("double").alias("value"))
    return inference.robust_effect(v, x, {"nation": m["nation"]}).select("support", _r("slope"))


# --- points: two components of the embeddings, the label as value and region


def _points(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("ord"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").cast("double").alias("value"))


def _knn(spark: SparkSession, sf: str, k: int = 4) -> DataFrame:
    at = _points(spark, sf)
    near = topology.symmetric(topology.nearest(at, at, k, "xy").drop("rank"), "union")
    return topology.styled(near.select("i", "j", F.lit(1.0).alias("w_raw")), "W")


_E = "with e as (select vec_id as ord, cast(embedding[1] as double) x, cast(embedding[2] as double) y, cast(label as double) v from embeddings), cand as (select a.ord i, b.ord j, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) d from e a join e b on a.ord <> b.ord) "
_KNN = _E + ", nb as (select i, j, d from (select *, row_number() over (partition by i order by d, j) rn from cand) where rn <= 4), sym as (select i, j, min(d) d from (select i, j, d from nb union all select j, i, d from nb) group by 1, 2), w as (select i, j, 1.0/count(*) over (partition by i) w from sym), z as (select ord, v, v - avg(v) over () z, sum(1) over () n from e), m as (select count(*) n, var_pop(v) * count(*) m2, avg(v) mean, stddev_pop(v) sd from e) "


@query(_E + "select i, j, round(d, 9) as distance, cast(rn as integer) as rank from (select *, row_number() over (partition by i order by d, j) rn from cand) where rn <= 4")
def nearest_neighbours(spark, sf):  # noqa: ANN001, ANN201
    at = _points(spark, sf)
    return topology.nearest(at, at, 4, "xy").select("i", "j", _r("distance", 9), "rank")


@query(_E + "select i, j, round(d, 9) as distance from cand where d <= 0.25")
def distance_band(spark, sf):  # noqa: ANN001, ANN201
    at = _points(spark, sf)
    return topology.within(at, at, 0.25, "xy").where("i <> j").select("i", "j", _r("distance", 9))


@query(_KNN + "select i, j, round(w, 9) as w from w")
def weights_knn(spark, sf):  # noqa: ANN001, ANN201
    return _knn(spark, sf).select("i", "j", _r("w", 9))


@query(_E + ", b as (select i, j, exp(-0.5 * (d / 0.1) * (d / 0.1)) r from cand where d <= 0.25) select i, j, round(r / sum(r) over (partition by i), 9) as w from b")
def weights_gaussian(spark, sf):  # noqa: ANN001, ANN201
    at = _points(spark, sf)
    return topology.weights_within(at, 0.25, lambda d: np.exp(-0.5 * (d / 0.1) ** 2), "xy").select("i", "j", _r("w", 9))


@query(_E + ", b as (select i, j, 1 / d r from cand where d <= 0.25 and d > 0) select i, j, round(r / sum(r) over (partition by i), 9) as w from b")
def weights_inverse_distance(spark, sf):  # noqa: ANN001, ANN201
    at = _points(spark, sf)
    return topology.weights_within(at, 0.25, lambda d: 1 / d, "xy", apart=True).select("i", "j", _r("w", 9))


def _label(spark, sf):  # noqa: ANN001, ANN202
    return _points(spark, sf).select("ord", "value")


@query(_KNN + ", t as (select sum(w.w * a.z * b.z) top, sum(w.w) s0 from w join z a on a.ord = w.i join z b on b.ord = w.j) select round(m.n / s0 * top / m2, 9) as statistic, round(-1.0 / (m.n - 1), 9) as expected, m.n as n from t, m")
def moran(spark, sf):  # noqa: ANN001, ANN201
    return statistics.moran(_label(spark, sf), _knn(spark, sf)).select(_r("statistic", 9), _r("expected", 9), "n")


@query(_KNN + ", t as (select sum(w.w * (a.v - b.v) * (a.v - b.v)) top, sum(w.w) s0 from w join z a on a.ord = w.i join z b on b.ord = w.j) select round((m.n - 1) / (2 * s0) * top / m2, 9) as statistic, m.n as n from t, m")
def geary(spark, sf):  # noqa: ANN001, ANN201
    return statistics.geary(_label(spark, sf), _knn(spark, sf)).select(_r("statistic", 9), "n")


@query(_KNN + ", l as (select w.i ord, sum(w.w * b.z) lag from w join z b on b.ord = w.j group by 1) select z.ord as ord, round(z.z * lag / (m2 / m.n), 8) as statistic, case when z.z >= 0 and lag >= 0 then 'high-high' when z.z < 0 and lag < 0 then 'low-low' when z.z >= 0 then 'high-low' else 'low-high' end as quadrant from z join l using (ord), m")
def local_moran(spark, sf):  # noqa: ANN001, ANN201
    return statistics.local_moran(_label(spark, sf), _knn(spark, sf)).select("ord", _r("statistic", 8), "quadrant")


@query(_KNN + ", s as (select i, j from sym union all select ord, ord from e), g as (select i ord, sum(v) top, count(*) k from s join e on ord = j group by 1) select g.ord as ord, round((top - mean * k) / (sd * sqrt((n * k - k * k) / (n - 1))), 8) as statistic from g, m")
def getis_ord_star(spark, sf):  # noqa: ANN001, ANN201
    return statistics.getis_ord(_label(spark, sf), _knn(spark, sf)).select("ord", _r("statistic", 8))


@query(_KNN + ", g as (select i ord, sum(v) top, count(*) k from sym join e on ord = j group by 1), s as (select sum(v) s, sum(v*v) s2, count(*) n from e) select g.ord as ord, round((top - (s - v) / (n - 1) * k) / (sqrt((s2 - v*v) / (n - 1) - power((s - v) / (n - 1), 2)) * sqrt(((n - 1) * k - k * k) / (n - 2))), 8) as statistic from g join e using (ord), s")
def getis_ord(spark, sf):  # noqa: ANN001, ANN201
    return statistics.getis_ord(_label(spark, sf), _knn(spark, sf), star=False).select("ord", _r("statistic", 8))


@query(_KNN + ", two as (select distinct a.i, b.j from sym a join sym b on a.j = b.i where a.i <> b.j except select i, j from sym), o as (select 1 as ord_, i, j from sym union all select 2, i, j from two), c as (select ord_, i, j, 1.0 / count(*) over (partition by ord_, i) w from o), t as (select ord_, sum(w * a.z * b.z) top, sum(w) s0, count(*) pairs from c join z a on a.ord = i join z b on b.ord = j group by 1) select cast(ord_ as integer) as \"order\", round(m.n / s0 * top / m2, 9) as statistic, pairs from t, m")
def correlogram(spark, sf):  # noqa: ANN001, ANN201
    return statistics.correlogram(_label(spark, sf), _knn(spark, sf), 2).select("order", _r("statistic", 9), "pairs")


@query(_E + ", p as (select d, 0.5 * (a.v - b.v) * (a.v - b.v) g from cand join e a on a.ord = i join e b on b.ord = j where i < j and d <= 0.5) select cast(greatest(1, ceil(d / 0.1 - 1e-12)) as integer) as bin, round(avg(d), 8) as distance, round(avg(g), 8) as gamma, count(*) as n from p group by 1")
def variogram(spark, sf):  # noqa: ANN001, ANN201
    at = _points(spark, sf)
    found = statistics.binned_within(at.select("ord", "value"), at.select("ord", "x", "y"), 0.5, 5, "xy")
    return found.select(F.col("bin").cast("int").alias("bin"), _r("distance", 8), _r("gamma", 8), "n")


@query(_KNN + ", c as (select least(a.v, b.v) region_a, greatest(a.v, b.v) region_b from sym join e a on a.ord = i join e b on b.ord = j where i < j and a.v <> b.v) select cast(cast(region_a as integer) as varchar) as region_a, cast(cast(region_b as integer) as varchar) as region_b, cast(count(*) as double) as w_raw from c group by 1, 2")
def region_adjacency(spark, sf):  # noqa: ANN001, ANN201
    regions = _label(spark, sf).select("ord", F.col("value").cast("int").cast("string").alias("region_id"))
    return topology.region_adjacency(_knn(spark, sf), regions, "edge_count")


@query(_KNN + "select i, j from sym join e a on a.ord = i join e b on b.ord = j where i < j and a.v <> b.v")
def region_boundary(spark, sf):  # noqa: ANN001, ANN201
    regions = _label(spark, sf).select("ord", F.col("value").cast("int").cast("string").alias("region_id"))
    return topology.boundary(_knn(spark, sf), regions).select("i", "j")


@query("select cast(n_nationkey as bigint) as ord, cast(min(n_nationkey) over (partition by n_regionkey) as bigint) as root from nation")
def connected_components(spark, sf):  # noqa: ANN001, ANN201
    from pyspark.sql import Window

    n = _table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("ord"), "n_regionkey")
    chain = n.withColumn("j", F.lag("ord").over(Window.partitionBy("n_regionkey").orderBy("ord"))).where("j is not null").select(F.col("ord").alias("i"), "j")
    from latticework.operators.graph import components

    return components(chain, n).select("ord", "root")


@query(_E + ", k as (select i, exp(-0.5 * (d / 0.2) * (d / 0.2)) w, e.x, e.v from (select i, j, d from cand where d <= 0.6 union all select ord, ord, 0.0 from e) c join e on e.ord = c.j), s as (select i, sum(w) s, sum(w*x) x, sum(w*v) v, sum(w*x*x) xx, sum(w*x*v) xv from k group by 1) select i as ord, round((s * xv - x * v) / (s * xx - x * x), 5) as estimate from s")
def local_regression(spark, sf):  # noqa: ANN001, ANN201
    p = _points(spark, sf).withColumn("px", F.col("x"))
    fits = models.gwr(p.select("ord", "value", "px"), p.select("ord", "x", "y"), "value", ["px"], 0.2, "gaussian", dims="xy")
    return fits.where("term = 'px'").select("ord", _r("estimate", 5))


@query(_E + ", r as (select unnest([0.1, 0.2, 0.4]) radius), c as (select radius, count(*) pairs, sum((case when a.v >= 5 then 1 else 0 end) * (case when b.v >= 5 then 1 else 0 end)) o from cand join e a on a.ord = i join e b on b.ord = j, r where d <= radius group by 1), t as (select count(*) n, count(*) filter (where v >= 5) k from e) select cast(radius as double) as radius, cast(o as double) as observed, round(o / (cast(pairs as double) * k * k / (cast(n as double) * n)), 8) as enrichment from c, t")
def point_enrichment(spark, sf):  # noqa: ANN001, ANN201
    p = _points(spark, sf)
    events = p.where("value >= 5").select("ord", F.lit(1).alias("n"))
    return gis.pair_enrichment(events, p.select("ord", "x", "y"), [0.1, 0.2, 0.4], "xy").select("radius", "observed", _r("enrichment", 8))


@query(_KNN + ", q as (select quantile_cont(v, 0.8) q from e), g as (select i ord, sqrt(avg((a.v - b.v) * (a.v - b.v))) g from sym join e a on a.ord = i join e b on b.ord = j group by 1) select e.ord as ord, v >= q as active, round(g, 8) as gradient from e join g using (ord), q")
def landscape(spark, sf):  # noqa: ANN001, ANN201
    return gis.landscape(_label(spark, sf), _knn(spark, sf), 0.8).select("ord", "active", _r("gradient", 8))


@query(_KNN + ", s as (select ord, (x - (select avg(x) from e)) / (select stddev_pop(x) from e) zx, (y - (select avg(y) from e)) / (select stddev_pop(y) from e) zy from e), l as (select w.i ord, sum(w.w * s.zy) lag from w join s on s.ord = w.j group by 1), g as (select w.i ord, sum(w.w * (a.zx - b.zx) * (a.zy - b.zy)) g from w join s a on a.ord = w.i join s b on b.ord = w.j group by 1) select s.ord as ord, round(zx * lag, 8) as cross_moran, round(g, 8) as cross_geary from s join l using (ord) join g using (ord)")
def local_coupling(spark, sf):  # noqa: ANN001, ANN201
    p = _points(spark, sf)
    found = multilayer.local_coupling(p.select("ord", F.col("x").alias("value")), p.select("ord", F.col("y").alias("value")), _knn(spark, sf))
    return found.select("ord", _r("cross_moran", 8), _r("cross_geary", 8))


# --- lattices and meshes: cells that have parts, parts as vertices of a square


@query("with c as (select distinct p_size - 1 i, cast(regexp_extract(p_brand, '([0-9]+)', 1) as integer) j from part), v as (select row_number() over (order by i + 50 * j) - 1 as ord, i, j from c) select a.ord as i, b.ord as j from v a join v b on abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1 and a.ord <> b.ord")
def voxel_adjacency(spark, sf):  # noqa: ANN001, ANN201
    """Faces and edges of the cells of one layer."""
    from latticework.queries_base import _lattice

    return topology.adjacency(_lattice(spark, sf), 18).select("i", "j")


def _side(spark: SparkSession, sf: str) -> int:
    return math.isqrt(_table(spark, sf, "part").count())


_MESH = "with s as (select cast(floor(sqrt(count(*))) as bigint) s from part), r as (select unnest(range(s - 1)) a from s), q as (select x.a * s + y.a as q, s from r x, r y, s), f as (select q a, q + 1 b, q + s c from q union all select q + 1, q + s + 1, q + s from q)"


@query(_MESH + ", c as (select a as ord from f union all select b from f union all select c from f) select ord, round(count(*) * 0.5 / 3, 9) as area from c group by 1")
def mesh_vertex_area(spark, sf):  # noqa: ANN001, ANN201
    return topology.vertex_area(_grid(spark, _side(spark, sf))).select("ord", _r("area", 9))


def _grid(spark: SparkSession, side: int):  # noqa: ANN202
    """A flat square of side x side vertices in two triangles a cell."""
    from latticework.model import surface

    at = spark.range(side * side).select(F.col("id").alias("ord"), (F.col("id") % side).cast("double").alias("x"), F.floor(F.col("id") / side).cast("double").alias("y"), F.lit(0.0).alias("z"))
    q = at.where((F.col("x") < side - 1) & (F.col("y") < side - 1)).select("ord")
    faces = q.select(F.explode(F.array(F.struct(F.col("ord").alias("v1"), (F.col("ord") + 1).alias("v2"), (F.col("ord") + side).alias("v3")), F.struct((F.col("ord") + 1).alias("v1"), (F.col("ord") + side + 1).alias("v2"), (F.col("ord") + side).alias("v3")))).alias("f"), "ord")
    faces = faces.select((2 * F.col("ord") + (F.col("f.v1") != F.col("ord")).cast("int")).alias("face_id"), "f.v1", "f.v2", "f.v3")
    return surface(spark, at, faces)


@query(_MESH + ", p as (select a i, b j from f union select b, c from f union select a, c from f), w as (select i, j from p union select j, i from p) select i as ord, count(*) as degree from w group by 1")
def mesh_degree(spark, sf):  # noqa: ANN001, ANN201
    return topology.adjacency(_grid(spark, _side(spark, sf))).groupBy(F.col("i").alias("ord")).agg(F.count("*").alias("degree"))


# --- layers: the columns of lineitem; merging aggregates


def _columns(spark: SparkSession, sf: str) -> DataFrame:
    li = _table(spark, sf, "lineitem")
    cols = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return li.select(F.inline(F.array(*[F.struct(F.lit(n).alias("layer_ord"), F.col(c).alias("value")) for n, c in enumerate(cols)])))


@query("with v as (select 0 as layer_ord, l_quantity as value from lineitem union all select 1, l_extendedprice from lineitem union all select 2, l_discount from lineitem union all select 3, l_tax from lineitem) select cast(layer_ord as integer) as layer_ord, count(value) as n, cast(count(*) filter (where value is null) as bigint) as missing, round(avg(value), 5) as mean, round(var_samp(value), 4) as variance, min(value) as min, max(value) as max from v group by 1")
def stream_summary(spark, sf):  # noqa: ANN001, ANN201
    return statistics.summary(_columns(spark, sf)).select("layer_ord", "n", "missing", _r("mean", 5), _r("variance", 4), "min", "max")


@query("select round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept, round(regr_slope(l_extendedprice, l_quantity), 4) as slope from lineitem")
def stream_regression(spark, sf):  # noqa: ANN001, ANN201
    fit = statistics.regression(_table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])
    return fit.agg(F.round(F.max(F.when(F.col("term") == "intercept", F.col("estimate"))), 2).alias("intercept"), F.round(F.max(F.when(F.col("term") == "l_quantity", F.col("estimate"))), 4).alias("slope"))


@query("select a, b, round(c, 6) as covariance from (select 0 as a, 1 as b, covar_samp(embedding[1]::double, embedding[2]::double) c from embeddings union all select 0, 0, var_samp(embedding[1]::double) from embeddings union all select 1, 1, var_samp(embedding[2]::double) from embeddings)")
def stream_covariance(spark, sf):  # noqa: ANN001, ANN201
    e = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("ord"), F.inline(F.array(*[F.struct(F.lit(n).alias("layer_ord"), F.col("embedding")[n].cast("double").alias("value")) for n in (0, 1)])))
    return statistics.covariance(e, [0, 1]).select("a", "b", _r("covariance"))


@query("with u as (select distinct lang from documents where lang is not null), f as (select distinct source from documents where source is not null), o as (select lang, source, count(*) n from documents group by 1, 2) select u.lang as unit_id, f.source as feature, coalesce(n, 0) > 0 as available from u cross join f left join o on o.lang = u.lang and o.source = f.source")
def layer_availability(spark, sf):  # noqa: ANN001, ANN201
    from latticework.model import Dataset, layer_index

    d = _table(spark, sf, "documents").where("lang is not null and source is not null").select(F.col("lang").alias("subject_id"), F.col("source").alias("feature")).distinct()
    layers = d.withColumn("layer_ord", F.xxhash64("subject_id", "feature"))
    x = Dataset("region", _label(spark, sf), d, layers, d)
    names = [r[0] for r in d.select("feature").distinct().collect()]
    return layer_index(x, required=names).select("unit_id", "feature", "available")


@query("with p as (select l_partkey k, sum(l_quantity) s, avg(l_discount) a, avg(l_tax) b from lineitem group by 1), t as (select sum(s) s, sum(s*a) a1, sum(s*b) b1, sum(s*a*a) a2, sum(s*b*b) b2, sum(s*a*b) ab from p) select 'u' as unit_id, 'discount|tax' as pair, round((ab/s - a1*b1/s/s) / sqrt((a2/s - a1*a1/s/s) * (b2/s - b1*b1/s/s)), 7) as same_location from t")
def layer_coupling(spark, sf):  # noqa: ANN001, ANN201
    p = _table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("ord")).agg(F.sum("l_quantity").alias("support"), F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    values = p.select("ord", F.inline(F.array(*[F.struct(F.lit(n).alias("layer_ord"), F.col(c).alias("value")) for n, c in enumerate("ab")])))
    index = spark.createDataFrame([("u", "discount", 0), ("u", "tax", 1)], "unit_id string, feature string, layer_ord int")
    return multilayer.coupling(values, index, [("discount", "tax")], p.select("ord", "support")).select("unit_id", "pair", _r("same_location", 7))


# --- time: users by day


def _days(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "events")
    v = e.groupBy(F.col("user_id").alias("ord"), F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("time_ord")).agg(F.sum("value").alias("value"))
    return v.withColumn("time", F.col("time_ord").cast("double"))


_DAYS = "with v as (select user_id as ord, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as integer) as t, sum(value) as value from events group by 1, 2) "


@query(_DAYS + "select ord, round(regr_slope(value, t), 5) as slope, round(regr_intercept(value, t), 4) as intercept from v group by 1")
def temporal_trend(spark, sf):  # noqa: ANN001, ANN201
    return temporal.trend(_days(spark, sf)).select("ord", _r("slope", 5), _r("intercept", 4))


@query(_DAYS + ", p as (select ord, max(case when t = 0 then value end) a, max(case when t = 7 then value end) b from v where t in (0, 7) group by 1) select ord, round(case when a <> 0 then 100 * (b - a) / a end, 4) as value from p")
def temporal_change(spark, sf):  # noqa: ANN001, ANN201
    return temporal.change(_days(spark, sf), 0, 7, "percent").select("ord", _r("value", 4))


@query(_DAYS + ", p as (select ord, 0.5 * (value + lag(value) over w) * (t - lag(t) over w) piece from v window w as (partition by ord order by t)) select ord, round(sum(piece), 4) as value from p group by 1")
def temporal_integral(spark, sf):  # noqa: ANN001, ANN201
    return temporal.contrast(_days(spark, sf), "integral").select("ord", _r("value", 4))


@query(_DAYS + "select ord, round(avg(value), 5) as value from v group by 1")
def temporal_mean(spark, sf):  # noqa: ANN001, ANN201
    return temporal.contrast(_days(spark, sf), "mean").select("ord", _r("value", 5))


@query(_DAYS + ", p as (select b.t - a.t d, 0.5 * (a.value - b.value) * (a.value - b.value) g from v a join v b on a.ord = b.ord and a.t < b.t where b.t - a.t <= 10) select cast(greatest(1, ceil(d / 2.0)) as integer) as bin, round(avg(d), 6) as distance, round(avg(g), 3) as gamma, count(*) as n from p group by 1")
def temporal_variogram(spark, sf):  # noqa: ANN001, ANN201
    return temporal.temporal_variogram(_days(spark, sf), 5, 10.0).select(F.col("bin").cast("int").alias("bin"), _r("distance"), _r("gamma", 3), "n")


def _chain(v: DataFrame) -> DataFrame:
    """Neighbouring days, up to the last one there is."""
    n = v.agg(F.max("time_ord")).first()[0] + 1
    return temporal.temporal_weights(temporal.time_axis(n=n), v.sparkSession, style="B")


@query(_DAYS + ", z as (select ord, t, value - avg(value) over (partition by ord) z from v), l as (select a.ord, a.t, sum(b.z) lag from z a join z b on a.ord = b.ord and abs(a.t - b.t) = 1 group by 1, 2) select z.ord as ord, round(count(*) / (2.0 * (select max(t) from v)) * sum(z * coalesce(lag, 0)) / nullif(sum(z * z), 0), 7) as statistic from z left join l using (ord, t) group by 1")
def temporal_moran(spark, sf):  # noqa: ANN001, ANN201
    v = _days(spark, sf)
    return temporal.temporal_moran(v, _chain(v)).select("ord", _r("statistic", 7))


@query(_DAYS + ", s as (select a.ord, a.t, sum(b.value) x from v a join v b on b.t = a.t and abs(a.ord - b.ord) = 1 group by 1, 2), l as (select a.ord, a.t, sum(b.value) x from v a join v b on a.ord = b.ord and abs(a.t - b.t) = 1 group by 1, 2) select v.ord as ord, v.t as time_ord, round(0.5 * coalesce(s.x, 0) + 0.5 * coalesce(l.x, 0), 4) as lag from v left join s using (ord, t) left join l using (ord, t)")
def spacetime_lag(spark, sf):  # noqa: ANN001, ANN201
    v = _days(spark, sf)
    users = v.select(F.col("ord").alias("i")).distinct()
    space = users.select("i", F.explode(F.array(F.col("i") - 1, F.col("i") + 1)).alias("j"), F.lit(1.0).alias("w"))
    return temporal.lagged(v, temporal.SpaceTime(space, _chain(v))).select("ord", "time_ord", _r("lag", 4))


@query(_DAYS + ", h as (select ord, list(case when value >= 20 then 1 else 0 end order by t) h from v group by 1), s as (select ord, h, list_sum(h) k, len(h) n, array_to_string(h, '') x from h) select ord, case when k = 0 then 'none' when h[n] = 0 then 'historical' when k = 1 then 'new' when k >= 0.9 * n then 'persistent' when regexp_matches(x, '^0*1+$') then 'consecutive' else 'recurrent' end as class from s")
def hotspot_classes(spark, sf):  # noqa: ANN001, ANN201
    return gis.hotspot_classes(_days(spark, sf).select("ord", "time_ord", F.col("value").alias("z")), 20.0)


# --- tests over many results


@query("with p as (select s_suppkey as id, (s_suppkey * 37 % 101 + 0.5) / 102.0 as p from supplier), r as (select id, p, row_number() over (order by p) rk, count(*) over () n from p) select id, round(min(least(1.0, p * n / rk)) over (order by p desc rows between unbounded preceding and current row), 9) as p_adjusted from r")
def adjusted_p_values(spark, sf):  # noqa: ANN001, ANN201
    p = _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") * 37 % 101 + 0.5) / 102.0).alias("p_value"))
    return statistics.benjamini_hochberg(p).select("id", _r("p_adjusted", 9))


@query("with e as (select p_size as scale, p_brand as zoning, avg(p_retailprice) - 1500 as effect from part group by 1, 2), g as (select avg(effect) grand, count(*) filter (where effect > 0) * count(*) filter (where effect < 0) rev from e), b as (select scale, avg(effect) m, count(*) n, var_pop(effect) * count(*) w from e group by 1), t as (select sum(n * (m - grand) * (m - grand)) b, sum(w) w from b, g) select 'scale' as source, round(b, 2) as sum_of_squares from t union all select 'zoning', round(w, 2) from t union all select 'sign_reversals', cast(rev as double) from g")
def maup(spark, sf):  # noqa: ANN001, ANN201
    e = _table(spark, sf, "part").groupBy(F.col("p_size").alias("scale"), F.col("p_brand").alias("zoning")).agg((F.avg("p_retailprice") - 1500).alias("effect"))
    return inference.maup(e).select("source", _r("sum_of_squares", 2))


# --- results that SQL does not express: draws, fits and iterations


@query()
def moran_permutation(spark, sf):  # noqa: ANN001, ANN201
    return statistics.permutation_test(_label(spark, sf), _knn(spark, sf), "moran", statistics.Permutations(199, 7))


@query()
def local_moran_permutation(spark, sf):  # noqa: ANN001, ANN201
    return statistics.local_permutation_test(_label(spark, sf), _knn(spark, sf), statistics.Permutations(99, 7, adjust="BH"))


@query()
def common_support_test(spark, sf):  # noqa: ANN001, ANN201
    v, m = _customers(spark, sf)
    x = v.select("ord", (F.col("ord") % 97).cast("double").alias("value"))
    return inference.common_test(v, x, {k: m[k] for k in ("nation", "segment")}, control=statistics.Permutations(199, 3))


@query()
def variogram_fit(spark, sf):  # noqa: ANN001, ANN201
    at = _points(spark, sf)
    bins = statistics.binned_within(at.select("ord", "value"), at.select("ord", "x", "y"), 0.5, 10, "xy")
    fit = models.fit_variogram(bins, "exponential")
    return spark.createDataFrame([(fit["nugget"], fit["sill"], fit["range"])], "nugget double, sill double, range double")


@query()
def kriging(spark, sf):  # noqa: ANN001, ANN201
    at = _points(spark, sf)
    grid = spark.range(100).select(F.col("id").alias("ord"), (F.col("id") % 10 / 5 - 1).alias("x"), (F.floor(F.col("id") / 10) / 5 - 1).alias("y"))
    return models.kriging(at.select("ord", "value"), at.select("ord", "x", "y"), grid, {"model": "exponential", "nugget": 1.0, "sill": 8.0, "range": 0.5}, 12, dims="xy")


@query()
def spatial_autoregression(spark, sf):  # noqa: ANN001, ANN201
    p = _points(spark, sf)
    return models.autoregression(p.select("ord", "value", F.col("x").alias("px")), _knn(spark, sf), "value", ["px"], "sar")


@query()
def conditional_autoregression(spark, sf):  # noqa: ANN001, ANN201
    return models.car(_label(spark, sf), _knn(spark, sf), tolerance=1e-6)


@query()
def spatial_basis(spark, sf):  # noqa: ANN001, ANN201
    mass = _label(spark, sf).select("ord", F.lit(1.0).alias("support"))
    return multilayer.laplacian_modes(_knn(spark, sf), mass, 16)[0]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from latticework import queries_base, queries_more, queries_rest  # noqa: E402, F401  they register themselves with the names above
