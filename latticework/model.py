"""The data model: a base of ordered elements, layers of values observed on it, and what they mean.

A dataset is a few DataFrames: ``elements`` (ord and what locates an element),
``values`` (ord, layer_ord, value), ``layers`` (layer_ord, layer_id, name,
measure_id and any further columns) and ``measures``; meshes add ``faces``.
Elements are identified by ``ord``, whose order is part of a base's identity.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("point", "surface", "volume", "composite", "region")
BEHAVIOURS = ("unknown", "intensive", "extensive", "count", "categorical")
AGGREGATION = {"intensive": "weighted_mean", "extensive": "sum", "count": "sum", "categorical": "mode", "unknown": "none"}
ELEMENT_COLUMNS = {"element_id": "string", "source_index": "int", "included": "boolean", "x": "double", "y": "double", "z": "double", "i": "int", "j": "int", "k": "int", "component_id": "string", "region_id": "string", "support": "double", "uncertainty": "double"}
MEASURE_SCHEMA = "measure_id string, name string, unit string, value_type string, support_behavior string, missing_policy string, aggregation string, temporal_semantics string"
COORDINATE_ROLES = ("anatomical", "registration", "visualization", "chart")


@dataclass(frozen=True)
class Space:
    """A coordinate system."""

    space_id: str = "unknown"
    kind: str = "unknown"
    unit: str = "unknown"
    dimension: int = 3
    structure: str | None = None
    template: str | None = None
    density: str | None = None
    resolution: str | None = None


@dataclass(frozen=True)
class Measure:
    """What the values of a layer mean; the aggregation follows from the support behaviour."""

    measure_id: str = "measure"
    name: str = "measure"
    unit: str = "unknown"
    value_type: str = "continuous"
    support_behavior: str = "unknown"
    missing_policy: str = "preserve"
    aggregation: str | None = None
    temporal_semantics: str = "instantaneous"

    def __post_init__(self):
        if self.support_behavior not in BEHAVIOURS:
            raise ValueError(f"unknown support behaviour {self.support_behavior!r}")
        if self.missing_policy not in ("preserve", "exclude"):
            raise ValueError(f"unknown missing policy {self.missing_policy!r}")
        if self.support_behavior == "categorical" and self.value_type == "continuous":
            object.__setattr__(self, "value_type", "categorical")
        if self.aggregation is None:
            object.__setattr__(self, "aggregation", AGGREGATION[self.support_behavior])

    def row(self) -> tuple:
        return (self.measure_id, self.name, self.unit, self.value_type, self.support_behavior, self.missing_policy, self.aggregation, self.temporal_semantics)


@dataclass(frozen=True)
class Dataset:
    kind: str
    elements: DataFrame
    values: DataFrame
    layers: DataFrame
    measures: DataFrame
    faces: DataFrame | None = None
    space: Space = field(default_factory=Space)
    affine: tuple[tuple[float, ...], ...] | None = None
    dim: tuple[int, int, int] | None = None
    coordinates: dict[str, DataFrame] = field(default_factory=dict)
    roles: dict[str, str] = field(default_factory=dict)
    labels: dict[str, DataFrame] = field(default_factory=dict)
    distortions: dict[str, dict] = field(default_factory=dict)
    time_axis: Any = None
    history: tuple[dict, ...] = ()

    @property
    def spark(self) -> SparkSession:
        return self.elements.sparkSession

    def noted(self, operation: str, **details: Any) -> Dataset:
        return replace(self, history=(*self.history, {"operation": operation, **details}))

    def layer_ord(self, layer: int | str) -> int:
        """The layer's number, from 0; names and ids are looked up and must be unique."""
        if isinstance(layer, int):
            return layer
        found = self.layers.where((F.col("layer_id") == layer) | (F.col("name") == layer)).select("layer_ord").limit(2).collect()
        if len(found) != 1:
            raise KeyError(f"{len(found)} layers named {layer!r}")
        return found[0][0]

    def layer(self, layer: int | str) -> DataFrame:
        """(ord, value) of one layer; pruned to it at the scan."""
        return self.values.where(F.col("layer_ord") == self.layer_ord(layer)).select("ord", "value")

    def behaviour(self, layer: int | str) -> str:
        row = self.layers.where(F.col("layer_ord") == self.layer_ord(layer)).join(self.measures, "measure_id").select("support_behavior").first()
        return row[0] if row else "unknown"

    def with_measures(self) -> DataFrame:
        """Values with the measure of their layer; layers and measures are broadcast, as they are small by nature."""
        return self.values.join(F.broadcast(self.layers.select("layer_ord", "measure_id").join(self.measures, "measure_id")), "layer_ord")


def elements_table(df: DataFrame) -> DataFrame:
    """``ord`` and every element column, null where ``df`` has none."""
    cols = [F.col("ord").cast("long").alias("ord")]
    for name, kind in ELEMENT_COLUMNS.items():
        own = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        if name == "element_id":
            own = F.coalesce(own, F.format_string("element_%08d", F.col("ord") + 1))
        if name == "included":
            own = F.coalesce(own, F.lit(True))
        if name == "source_index":
            own = F.coalesce(own, F.col("ord").cast("int"))
        cols.append(own.alias(name))
    return df.select(*cols)


def _values(spark: SparkSession, values: DataFrame | Sequence | None, names: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    """Long values from a long or wide DataFrame (ord and one column for each layer) or rows of numbers."""
    if isinstance(values, DataFrame):
        if {"ord", "layer_ord", "value"} <= set(values.columns):
            n = values.agg(F.max("layer_ord")).first()[0]
            return values.select(F.col("ord").cast("long"), F.col("layer_ord").cast("int"), F.col("value").cast("double")), [*(names or (f"layer_{k + 1}" for k in range((-1 if n is None else n) + 1)))]
        own = [c for c in values.columns if c != "ord"]
        pairs = F.array(*[F.struct(F.lit(k).alias("layer_ord"), F.col(f"`{c}`").cast("double").alias("value")) for k, c in enumerate(own)])
        return values.select(F.col("ord").cast("long").alias("ord"), F.inline(pairs)), [*(names or own)]
    table = np.asarray(values if values is not None else [], dtype=float)
    table = table.reshape(len(table), -1) if table.size else np.zeros((0, len(names or [])))
    rows = [(int(o), int(k), float(v)) for (o, k), v in np.ndenumerate(table)]
    return spark.createDataFrame(rows, "ord long, layer_ord int, value double"), [*(names or (f"layer_{k + 1}" for k in range(table.shape[1])))]


def make(spark: SparkSession, kind: str, elements: DataFrame, values: DataFrame | Sequence | None = None, names: Sequence[str] | None = None, measures: Measure | Sequence[Measure] | None = None, layers: DataFrame | None = None, **more: Any) -> Dataset:
    """Any base with values: one measure for all layers or one for each."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of base {kind!r}")
    long, found = _values(spark, values, names)
    own = [measures] * len(found) if isinstance(measures, Measure) else list(measures or [Measure()] * len(found))
    if len(own) != len(found):
        raise ValueError(f"{len(own)} measures for {len(found)} layers")
    if layers is None:
        layers = spark.createDataFrame([(k, f"layer_{k + 1:04d}", n, m.measure_id) for k, (n, m) in enumerate(zip(found, own, strict=True))], "layer_ord int, layer_id string, name string, measure_id string")
    distinct = {m.measure_id: m for m in own}
    return Dataset(kind, elements_table(elements), long, layers, spark.createDataFrame([m.row() for m in distinct.values()], MEASURE_SCHEMA), **more)


def _frame(spark: SparkSession, rows: DataFrame | Sequence, columns: Sequence[str], kind: str) -> DataFrame:
    if isinstance(rows, DataFrame):
        return rows
    made = [(n, *[float(v) if kind == "double" else int(v) for v in r]) for n, r in enumerate(rows)]
    used = columns[: len(made[0]) - 1] if made else columns
    return spark.createDataFrame(made, "ord long, " + ", ".join(f"{c} {kind}" for c in used))


def point(spark: SparkSession, coordinates: DataFrame | Sequence, values=None, **more: Any) -> Dataset:
    """Points in two or three dimensions."""
    return make(spark, "point", _frame(spark, coordinates, "xyz", "double"), values, **more)


def surface(spark: SparkSession, coordinates: DataFrame | Sequence, faces: DataFrame | Sequence, values=None, other: dict[str, DataFrame] | None = None, roles: dict[str, str] | None = None, **more: Any) -> Dataset:
    """A triangle mesh with zero-based faces; only anatomical coordinates are metric."""
    roles = {"active": "anatomical", **(roles or {})}
    if bad := set(roles.values()) - set(COORDINATE_ROLES):
        raise ValueError(f"unknown coordinate roles {sorted(bad)}")
    if not isinstance(faces, DataFrame):
        faces = spark.createDataFrame([(n, *map(int, f)) for n, f in enumerate(faces)], "face_id long, v1 long, v2 long, v3 long")
    return make(spark, "surface", _frame(spark, coordinates, "xyz", "double"), values, faces=faces, coordinates=dict(other or {}), roles=roles, **more)


def volume(spark: SparkSession, dim: Sequence[int], affine: Sequence[Sequence[float]], mask: Sequence[bool] | DataFrame | None = None, values=None, **more: Any) -> Dataset:
    """Active voxels of a lattice in column-major order, with world coordinates by the affine."""
    nx, ny, nz = (*dim, 1)[:3]
    a = np.asarray(affine, dtype=float)
    if a.shape != (4, 4) or abs(np.linalg.det(a[:3, :3])) < 1e-300:
        raise ValueError("the affine must be an invertible 4 x 4 matrix")
    if isinstance(mask, DataFrame):
        cells = mask.select(F.col("source_index").cast("long").alias("source_index"))
    elif mask is None:
        cells = spark.range(nx * ny * nz).withColumnRenamed("id", "source_index")
    else:
        flat = np.asarray(mask, dtype=bool).ravel(order="F") if np.ndim(mask) == 3 else np.asarray(mask, dtype=bool)
        if len(flat) != nx * ny * nz:
            raise ValueError("the mask does not fit the lattice")
        cells = spark.createDataFrame([(int(c),) for c in np.flatnonzero(flat)], "source_index long")
    if mask is None:
        cells = cells.withColumn("ord", F.col("source_index"))
    else:
        cells = ranked(cells, "source_index")
    found = cells.withColumn("i", F.col("source_index") % nx).withColumn("j", F.floor(F.col("source_index") / nx) % ny).withColumn("k", F.floor(F.col("source_index") / (nx * ny)))
    for row, name in zip(a, "xyz", strict=False):
        found = found.withColumn(name, row[0] * F.col("i") + row[1] * F.col("j") + row[2] * F.col("k") + row[3])
    return make(spark, "volume", found, values, affine=tuple(map(tuple, a)), dim=(nx, ny, nz), **more)


def ranked(df: DataFrame, *by: str) -> DataFrame:
    """Add ``ord``: the place of each row in the order of ``by``, without a single sorting task.

    Rows are dealt out by range, numbered inside the parts, and shifted by the
    parts' sizes.
    """
    from pyspark.sql import Window

    from .storage import cut

    dealt = cut(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = dealt.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*by)))
    return numbered.join(F.broadcast(before), "_part").withColumn("ord", F.col("_row") - 1 + F.col("_before")).drop("_part", "_row", "_before")


def composite(parts: dict[str, Dataset], values=None, **more: Any) -> Dataset:
    """An ordered union of surfaces and volumes; ordinals run on from part to part."""
    elements, faces, shift = [], [], 0
    for name, part in parts.items():
        elements.append(part.elements.withColumn("ord", F.col("ord") + shift).withColumn("component_id", F.lit(name)))
        if part.faces is not None:
            faces.append(part.faces.select("face_id", *[(F.col(v) + shift).alias(v) for v in ("v1", "v2", "v3")]))
        shift += part.elements.count()
    spark = next(iter(parts.values())).spark
    return make(spark, "composite", reduce(DataFrame.unionByName, elements), values, faces=reduce(DataFrame.unionByName, faces) if faces else None, **more)


def regions(spark: SparkSession, table: DataFrame, values=None, **more: Any) -> Dataset:
    """Regions (ord, region_id and, if known, x, y, z, support)."""
    return make(spark, "region", table, values, **more)


def update_measure(x: Dataset, measure_id: str, **changes: str) -> Dataset:
    """Change fields of one measure; the aggregation follows a changed behaviour."""
    if "support_behavior" in changes and "aggregation" not in changes:
        changes["aggregation"] = AGGREGATION[changes["support_behavior"]]
    edit = lambda c: F.when(F.col("measure_id") == measure_id, F.lit(changes[c])).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
    return replace(x, measures=x.measures.select(*[edit(c) for c in x.measures.columns])).noted("update_measure", measure=measure_id)


def subset(x: Dataset, elements: Column | Iterable[int] | None = None, layers: Sequence[int | str] | None = None) -> Dataset:
    """Select elements (a condition or ordinals) and layers; ordinals close up, faces and labels follow."""
    out = x
    if layers is not None:
        chosen = [x.layer_ord(k) for k in layers]
        renumber = F.create_map(*[F.lit(v) for pair in ((c, n) for n, c in enumerate(chosen)) for v in pair])
        own = lambda df: df.where(F.col("layer_ord").isin(chosen)).withColumn("layer_ord", F.element_at(renumber, F.col("layer_ord")))
        kept = own(x.layers)
        out = replace(out, values=own(x.values), layers=kept, measures=x.measures.join(F.broadcast(kept.select("measure_id").distinct()), "measure_id", "left_semi"))
    if elements is not None:
        cond = elements if isinstance(elements, Column) else F.col("ord").isin(list(map(int, elements)))
        kept = ranked(out.elements.where(cond).withColumnRenamed("ord", "_old"), "_old")
        new = kept.select(F.col("_old").alias("ord"), F.col("ord").alias("_new"))
        moved = lambda df: df.join(new, "ord").drop("ord").withColumnRenamed("_new", "ord").select(*df.columns)
        faces = out.faces
        for v in ("v1", "v2", "v3") if faces is not None else ():
            faces = faces.join(new.withColumnRenamed("ord", v), v).drop(v).withColumnRenamed("_new", v)
        out = replace(out, elements=kept.drop("_old").select("ord", *ELEMENT_COLUMNS), values=moved(out.values), faces=faces.select("face_id", "v1", "v2", "v3") if faces is not None else None, labels={k: moved(v) if "ord" in v.columns else v for k, v in out.labels.items()}, coordinates={k: moved(v) for k, v in out.coordinates.items()})
    return out.noted("subset")


def bind_layers(*parts: Dataset, conflicts: str = "error") -> Dataset:
    """The layers of several datasets on one base, which must be identical."""
    first = parts[0]
    if len({base_signature(p) for p in parts}) > 1:
        raise ValueError("the bases differ")
    values, layers, measures, shift = [], [], [], 0
    for n, part in enumerate(parts):
        own = part.layers.withColumn("layer_ord", (F.col("layer_ord") + shift).cast("int")).withColumn("layer_id", F.format_string("layer_%04d", F.col("layer_ord") + 1))
        if conflicts == "prefix":
            own = own.withColumn("name", F.concat(F.lit(f"{n + 1}_"), "name"))
        layers.append(own)
        values.append(part.values.withColumn("layer_ord", (F.col("layer_ord") + shift).cast("int")))
        measures.append(part.measures)
        shift += part.layers.count()
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)
    if conflicts == "error" and (twice := [r["name"] for r in table.groupBy("name").count().where("count > 1").collect()]):
        raise ValueError(f"layer names occur twice: {twice}")
    found = reduce(DataFrame.unionByName, measures).distinct()
    if clash := [r[0] for r in found.groupBy("measure_id").count().where("count > 1").collect()]:
        raise ValueError(f"measures differ under one id: {clash}")
    return replace(first, values=reduce(DataFrame.unionByName, values), layers=table, measures=found).noted("bind_layers", parts=len(parts))


def layer_index(x: Dataset, unit: str = "subject_id", feature: str = "feature", required: Sequence[str] | None = None, complete: str = "report") -> DataFrame:
    """(unit_id, feature, layer_ord, available) over all units and required features; a pair twice is an error."""
    own = x.layers.select(F.col(unit).alias("unit_id"), F.col(feature).alias("feature"), "layer_ord")
    if own.groupBy("unit_id", "feature").count().where("count > 1").take(1):
        raise ValueError("a unit has a feature twice")
    features = x.spark.createDataFrame([(f,) for f in required], "feature string") if required else own.select("feature").distinct()
    # layers are few: every unit with every feature is a table of their size
    grid = own.select("unit_id").distinct().join(F.broadcast(features), F.lit(True))
    out = grid.join(own, ["unit_id", "feature"], "left").withColumn("available", F.col("layer_ord").isNotNull())
    if complete == "error" and out.where("not available").take(1):
        raise ValueError("units lack required features")
    return out


def layer_view(x: Dataset, layer: int | str) -> Dataset:
    """One layer with its base and measure."""
    return subset(x, layers=[layer])


def set_chart(x: Dataset, coordinates: DataFrame, name: str = "chart", distortion: dict | None = None) -> Dataset:
    """Add planar coordinates (ord, x, y); they are never metric, and change the base's identity. What is known of their distortion goes with them."""
    known = {**x.distortions, name: dict(distortion)} if distortion is not None else x.distortions
    return replace(x, coordinates={**x.coordinates, name: coordinates}, roles={**x.roles, name: "chart"}, distortions=known).noted("set_chart", chart=name, distortion_recorded=distortion is not None)


def chart_distortion(x: Dataset, chart: str | None = None) -> dict | None:
    """What was recorded of a chart's distortion, None if nothing; the only chart if none is named."""
    charts = [k for k, v in x.roles.items() if v == "chart" and k in x.coordinates]
    if chart is None and len(charts) != 1 or chart is not None and chart not in charts:
        raise KeyError(f"charts are {charts}")
    return x.distortions.get(chart or charts[0])


#: Fields of older containers and what they are called now; kinds of base likewise.
LEGACY_FIELDS = {"domain": "base", "domain.space": "base.coordinate_space", "maps": "layers", "maps.map_id": "layers.layer_id", "provenance": "history", "measures.spatial_semantics": "measures.support_behavior", "measures.units": "measures.unit", "measures.default_aggregation": "measures.aggregation"}
LEGACY_KINDS = {"points": "point", "surface": "surface", "volume": "volume", "regions": "region", "grayordinates": "composite"}


def migrate_legacy(spark: SparkSession, container: dict, strict: bool = True) -> Dataset | dict:
    """An older container (domain, values, maps, measures, labels, provenance) as a dataset.

    domain has type, space, elements (rows by column name) and, as its type has
    them, faces, affine and dim; values is a table of elements by maps. What
    cannot be taken over gives a report: status, type, issues and the field map.
    """
    issues = [f"missing {k}" for k in ("domain", "values", "maps", "measures", "labels", "provenance") if k not in container]
    domain = container.get("domain") if isinstance(container.get("domain"), dict) else {}
    report = lambda found: {"status": "reconstruction_required", "type": domain.get("type"), "issues": found, "field_map": dict(LEGACY_FIELDS)}
    if issues or domain.get("type") not in LEGACY_KINDS:
        return report(issues or ["the type of the domain is unknown"])
    try:
        rows = [{"ord": n, **e} for n, e in enumerate(domain["elements"])]
        known = [c for c in ("ord", *ELEMENT_COLUMNS) if any(c in r for r in rows)]
        kinds = {"ord": "long", **ELEMENT_COLUMNS}
        typed = [tuple(float(r[c]) if r.get(c) is not None and kinds[c] == "double" else r.get(c) for c in known) for r in rows]
        elements = spark.createDataFrame(typed, ", ".join(f"{c} {kinds[c]}" for c in known))
        meant = {m["measure_id"]: Measure(m["measure_id"], m.get("name", m["measure_id"]), m.get("units", "unknown"), m.get("value_type", "continuous"), m.get("spatial_semantics", "unknown"), m.get("missing_policy", "preserve"), m.get("default_aggregation")) for m in container["measures"]}
        maps = container["maps"]
        layers = spark.createDataFrame([(n, m["map_id"], m.get("name", m["map_id"]), m["measure_id"]) for n, m in enumerate(maps)], "layer_ord int, layer_id string, name string, measure_id string")
        space = Space(**{k: v for k, v in (domain.get("space") or {}).items() if k in Space.__dataclass_fields__})
        more = {"faces": spark.createDataFrame([(n, *map(int, f)) for n, f in enumerate(domain["faces"])], "face_id long, v1 long, v2 long, v3 long")} if domain.get("faces") else {}
        if domain.get("affine"):
            more |= {"affine": tuple(tuple(map(float, r)) for r in domain["affine"]), "dim": tuple(domain["dim"])}
        labels = {k: spark.createDataFrame([(n, str(v)) for n, v in enumerate(own)], "ord long, label string") for k, own in (container["labels"] or {}).items()}
        found = make(spark, LEGACY_KINDS[domain["type"]], elements, container["values"], [m.get("name", m["map_id"]) for m in maps], [meant[m["measure_id"]] for m in maps], layers, space=space, labels=labels, **more)
    except (KeyError, TypeError, ValueError) as e:
        return report([f"{type(e).__name__}: {e}"])
    if bad := [r["check"] for r in validate(found, "strict" if strict else "basic").where("violations > 0").collect()]:
        return report(bad)
    return replace(found, history=({"operation": "source", "provenance": container["provenance"]},)).noted("migrate_legacy", type=domain["type"])


#: Rows that the driver holds at a time while it deals out blocks.
SLAB = 1 << 20


def value_blocks(x: Dataset, rows: int = 65_536, layers: Sequence[int | str] | None = None):
    """Blocks of values by ordinal, one at a time on the driver; a pushed-down range reads as many of them at once as SLAB holds."""
    top = x.elements.agg(F.max("ord")).first()[0]
    chosen = [x.layer_ord(k) for k in layers] if layers is not None else None
    end = (-1 if top is None else top) + 1
    width = max(1, SLAB // max(1, len(chosen) if chosen is not None else x.layers.count()) // rows) * rows
    for slab in range(0, end, width):
        part = x.values.where((F.col("ord") >= slab) & (F.col("ord") < min(slab + width, end)))
        held = (part.where(F.col("layer_ord").isin(chosen)) if chosen is not None else part).toPandas().sort_values("ord", kind="stable")
        marks = np.searchsorted(held["ord"].to_numpy(), np.arange(slab, min(slab + width, end) + rows, rows))
        for k in range(-(-(min(slab + width, end) - slab) // rows)):
            yield held.iloc[marks[k] : marks[k + 1]].reset_index(drop=True)


def capabilities(x: Dataset) -> dict[str, bool]:
    """What can be asked of the base."""
    metric = x.kind in ("point", "surface", "volume", "composite")
    return {
        "coordinates": metric, "topology": x.kind in ("surface", "volume", "composite"), "areas": x.faces is not None, "volumes": x.kind == "volume", "geodesic": x.faces is not None,
        "euclidean": metric, "regions": x.kind == "region", "composite": x.kind == "composite", "time": x.time_axis is not None, "charts": "chart" in x.roles.values(), "labels": bool(x.labels),
    }


def canonical(value: Any) -> str:
    """JSON with sorted keys, full-precision numbers and nulls as NA."""

    def plain(v: Any) -> Any:
        if v is None or isinstance(v, float) and v != v:
            return "NA"
        if isinstance(v, dict):
            return {str(k): plain(v[k]) for k in sorted(v, key=str)}
        if isinstance(v, list | tuple):
            return [plain(w) for w in v]
        if isinstance(v, np.generic):
            return plain(v.item())
        return v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha256(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def table_hash(df: DataFrame) -> tuple[int, int, int]:
    """A digest of a table's rows that needs no order and no collecting: count, sum and xor of row hashes."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    row = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return int(row[0]), int(row[1] or 0), int(row[2] or 0)


def base_signature(x: Dataset) -> str:
    """Identity of the ordered base, labels left out."""
    parts = {"kind": x.kind, "space": vars(x.space), "affine": x.affine, "dim": x.dim, "elements": table_hash(x.elements)}
    if x.faces is not None:
        parts["faces"] = table_hash(x.faces)
    parts["coordinates"] = {k: table_hash(v) for k, v in x.coordinates.items()}
    return sha256(parts)


def logical_hash(x: Dataset) -> str:
    """Identity of the whole content."""
    return sha256({"base": base_signature(x), "values": table_hash(x.values), "layers": table_hash(x.layers), "measures": table_hash(x.measures)})


def validate(x: Dataset, level: str = "basic") -> DataFrame:
    """(check, level, violations): basic, strict and scientific contracts; no row is collected but the counts."""
    spark, rows = x.spark, []

    def check(name: str, own: str, bad: DataFrame) -> None:
        rows.append((name, own, bad.count()))

    check("ordinals are unique", "basic", x.elements.groupBy("ord").count().where("count > 1"))
    n, top = x.elements.agg(F.count("*"), F.max("ord")).first()
    rows.append(("ordinals are contiguous from 0", "basic", int(n > 0 and top != n - 1)))
    check("element ids are unique", "basic", x.elements.groupBy("element_id").count().where("count > 1"))
    check("values have elements", "basic", x.values.join(x.elements, "ord", "left_anti"))
    check("values have layers", "basic", x.values.join(F.broadcast(x.layers), "layer_ord", "left_anti"))
    check("one value for an element and layer", "basic", x.values.groupBy("ord", "layer_ord").count().where("count > 1"))
    check("layer ids are unique", "basic", x.layers.groupBy("layer_id").count().where("count > 1"))
    check("layers have measures", "basic", x.layers.join(F.broadcast(x.measures), "measure_id", "left_anti"))
    if x.faces is not None:
        corners = x.faces.select("face_id", F.explode(F.array("v1", "v2", "v3")).alias("ord"))
        check("face corners are elements", "basic", corners.join(x.elements, "ord", "left_anti"))
        check("faces have three corners", "basic", x.faces.where("v1 = v2 or v2 = v3 or v1 = v3"))
    if level in ("strict", "scientific"):
        check("coordinates are finite", "strict", x.elements.where(reduce(lambda a, b: a | b, [F.isnan(c) | (F.abs(c) == float("inf")) for c in "xyz"])))
        check("values are complete", "strict", x.elements.join(F.broadcast(x.layers.select("layer_ord")), F.lit(True)).join(x.values, ["ord", "layer_ord"], "left_anti"))
        check("supports are positive", "strict", x.elements.where("support <= 0"))
    if level == "scientific":
        check("support behaviour is known", "scientific", x.measures.where("support_behavior = 'unknown'"))
        check("units are known", "scientific", x.measures.where("unit = 'unknown'"))
        rows.append(("space is known", "scientific", int(x.space.space_id == "unknown")))
    return spark.createDataFrame(rows, "check string, level string, violations long")


@dataclass(frozen=True)
class Relation:
    """Observed pairwise data (from_ord, to_ord, value) bound to a base."""

    base: str
    data: DataFrame
    kind: str
    directed: bool = False


def relation(x: Dataset, data: DataFrame, kind: str, directed: bool = False) -> Relation:
    """Undirected pairs are put in order; pairs twice and unknown ends are errors; derived geometry is not a relation."""
    if kind in ("distance", "adjacency", "weights"):
        raise ValueError(f"{kind} is derived from the base, not observed")
    if not directed:
        data = data.select(F.least("from_ord", "to_ord").alias("from_ord"), F.greatest("from_ord", "to_ord").alias("to_ord"), "value")
    if data.groupBy("from_ord", "to_ord").count().where("count > 1").take(1):
        raise ValueError("a pair occurs twice")
    ends = data.select(F.explode(F.array("from_ord", "to_ord")).alias("ord"))
    if ends.join(x.elements, "ord", "left_anti").take(1):
        raise ValueError("an end is not an element")
    return Relation(base_signature(x), data, kind, directed)


def validate_relation(r: Relation, x: Dataset | None = None) -> bool:
    if x is not None and r.base != base_signature(x):
        raise ValueError("the relation belongs to another base")
    return True


def planar_features(x: Dataset, feature: str = "element", chart: str | None = None, most: int | None = None) -> DataFrame:
    """Points or triangles of planar coordinates as well-known text, a row for each; more than ``most``, if that is given, are refused."""
    at = x.coordinates[chart] if chart else x.elements.select("ord", "x", "y")
    if most is not None and (n := (x.faces if feature == "face" else at).count()) > most:
        raise ValueError(f"{n} features; the limit is {most}")
    if feature == "element":
        return at.select("ord", F.format_string("POINT (%s %s)", F.col("x").cast("string"), F.col("y").cast("string")).alias("geometry"))
    found = x.faces
    for v in ("v1", "v2", "v3"):
        found = found.join(at.select(F.col("ord").alias(v), F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string")).alias(f"p{v}")), v)
    return found.select("face_id", F.format_string("POLYGON ((%s, %s, %s, %s))", "pv1", "pv2", "pv3", "pv1").alias("geometry"))
