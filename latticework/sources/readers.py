"""Reading and writing datasets in imaging formats and raw matrices.

Files come through Spark's binary reader, so any store that Spark reaches will
do; each file is decoded in one task, and many files in many. Raw matrices are
read by ranges of rows through a data source of their own.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from latticework.model import Dataset, Measure, make, surface, volume
from latticework.storage import collected

from . import formats

_SUFFIXES = ((".dscalar.nii", "cifti"), (".dlabel.nii", "cifti"), (".dtseries.nii", "cifti"), (".nii", "nifti"), (".nii.gz", "nifti"), (".gii", "gifti"), (".mgh", "mgh"), (".mgz", "mgh"))


def format_of(path: str) -> str:
    return next((f for s, f in _SUFFIXES if path.endswith(s)), "freesurfer")


def raw_bytes(spark: SparkSession, path: str) -> bytes:
    """One file's bytes on the driver, for headers and geometry."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def image_values(spark: SparkSession, path: str, format: str | None = None, frames: list[int] | None = None, mask: np.ndarray | None = None) -> DataFrame:
    """(path, source_index, frame, value) of one or many volumes (a folder or pattern), decoded on the executors."""
    kind = format or format_of(path)
    decode = formats.read_mgh if kind == "mgh" else formats.read_nifti
    keep = None if mask is None else np.flatnonzero(np.asarray(mask, dtype=bool).ravel(order="F"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, raw in zip(part["path"], part["content"], strict=True):
                data = decode(raw, frames=frames).data
                flat = data.reshape(-1, data.shape[3], order="F")
                at = np.arange(len(flat)) if keep is None else keep
                for f in range(flat.shape[1]):
                    yield pd.DataFrame({"path": p, "source_index": at, "frame": np.int32(f if frames is None else frames[f]), "value": flat[at, f]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, source_index long, frame int, value double")


def read_image(spark: SparkSession, path: str, mask: np.ndarray | None = None, frames: list[int] | None = None, measure: Measure | None = None, affine: str = "auto", format: str | None = None) -> Dataset:
    """A volume with a layer for each frame."""
    kind = format or format_of(path)
    raw = raw_bytes(spark, path)
    head = formats.read_mgh(raw, [0]) if kind == "mgh" else formats.read_nifti(raw, affine, [0])
    long = image_values(spark, path, kind, frames, mask)
    base = volume(spark, head.data.shape[:3], head.affine, mask if mask is None else np.asarray(mask).ravel(order="F"))
    at = base.elements.select("ord", F.col("source_index").cast("long").alias("source_index"))
    chosen = sorted(r[0] for r in long.select("frame").distinct().collect())
    place = F.element_at(F.create_map(*[F.lit(v) for n, f in enumerate(chosen) for v in (f, n)]), F.col("frame"))
    values = long.join(at, "source_index").select("ord", place.alias("layer_ord"), "value")
    return make(spark, "volume", base.elements, values, [f"frame_{f}" for f in chosen], measure, affine=base.affine, dim=base.dim)


def write_image(x: Dataset, path: str, kind: str = "f4", overwrite: bool = False) -> None:
    """A volume's layers as frames, 0 outside the mask, with the mask and a description beside it."""
    table = collected(x.values.join(x.elements.select("ord", "source_index"), "ord"))
    n = int(x.layers.count())
    flat, mask = np.zeros((int(np.prod(x.dim)), n)), np.zeros(int(np.prod(x.dim)))
    flat[table["source_index"], table["layer_ord"]] = table["value"]
    mask[collected(x.elements.select("source_index"))["source_index"]] = 1
    image = formats.Image(flat.reshape(*x.dim, n, order="F"), np.asarray(x.affine))
    mgh = format_of(path) == "mgh"
    body = formats.write_mgh(image, path.endswith("z")) if mgh else formats.write_nifti(image, kind, path.endswith(".gz"))
    atomic(path, body, overwrite)
    if not mgh:
        stem = path.removesuffix(".gz").removesuffix(".nii")
        atomic(f"{stem}_mask.nii", formats.write_nifti(formats.Image(mask.reshape(x.dim, order="F"), np.asarray(x.affine)), "u1"), overwrite)
        atomic(f"{stem}.json", json.dumps({"history": list(x.history), "layers": [r.asDict() for r in x.layers.orderBy("layer_ord").collect()]}, default=str).encode(), overwrite)


def read_gifti(spark: SparkSession, geometry: str, data: list[str] | str | None = None, measure: Measure | None = None) -> Dataset:
    """A surface from its geometry file, with layers from metric or label files of the same vertices."""
    arrays, _ = formats.read_gifti(raw_bytes(spark, geometry))
    at = next(a for i, a, _ in arrays if i == "NIFTI_INTENT_POINTSET")
    faces = next(a for i, a, _ in arrays if i == "NIFTI_INTENT_TRIANGLE")
    columns = [c for p in ([data] if isinstance(data, str) else data or []) for i, a, _ in formats.read_gifti(raw_bytes(spark, p))[0] if i not in ("NIFTI_INTENT_POINTSET", "NIFTI_INTENT_TRIANGLE") for c in (a.T if a.ndim > 1 else [a])]
    if any(len(c) != len(at) for c in columns):
        raise ValueError("data and vertices differ in number")
    return surface(spark, at.tolist(), faces.tolist(), np.column_stack(columns) if columns else None, measures=measure)


def write_gifti(x: Dataset, path: str, overwrite: bool = False) -> None:
    at = collected(x.elements.orderBy("ord"))[["x", "y", "z"]].to_numpy()
    faces = collected(x.faces.orderBy("face_id"))[["v1", "v2", "v3"]].to_numpy()
    arrays = [("NIFTI_INTENT_POINTSET", at.astype("f4")), ("NIFTI_INTENT_TRIANGLE", faces.astype("i4"))]
    arrays += [("NIFTI_INTENT_SHAPE", collected(x.layer(k).orderBy("ord"))["value"].to_numpy().astype("f4")) for k in range(x.layers.count())]
    atomic(path, formats.write_gifti(arrays), overwrite)


def read_freesurfer(spark: SparkSession, geometry: str, data: str | None = None, labels: str | None = None, measure: Measure | None = None) -> Dataset:
    v, f = formats.read_surface(raw_bytes(spark, geometry))
    values = formats.read_curv(raw_bytes(spark, data)) if data else None
    x = surface(spark, v.tolist(), f.tolist(), values, measures=measure)
    if labels:
        keys, names = formats.read_annot(raw_bytes(spark, labels))
        x.labels["annot"] = spark.createDataFrame([(n, names.get(int(k), ("unknown",))[0]) for n, k in enumerate(keys)], "ord long, label string")
    return x


def read_cifti(spark: SparkSession, path: str, measure: Measure | None = None) -> Dataset:
    """An ordered composite of surfaces and voxels; the vertices' geometry is not in the file."""
    c = formats.read_cifti(raw_bytes(spark, path))
    rows, n = [], 0
    for b in c.models:
        for where in b["vertices"] if b["type"] == "surface" else b["voxels"]:
            i, j, k = (None, None, None) if b["type"] == "surface" else map(int, where)
            rows.append((n, int(where) if b["type"] == "surface" else n, b["structure"], i, j, k))
            n += 1
    elements = spark.createDataFrame(rows, "ord long, source_index int, component_id string, i int, j int, k int")
    own = measure or (Measure(support_behavior="categorical") if c.kind == "dlabel" else Measure())
    x = make(spark, "composite", elements, c.data, c.names[: c.data.shape[1]] or None, own, affine=tuple(map(tuple, c.affine.tolist())) if c.affine is not None else None, dim=c.dim)
    if c.labels:
        x.labels["table"] = spark.createDataFrame([(k, t) for k, (t, _) in c.labels.items()], "key int, label string")
    if c.series:
        from latticework.operators.temporal import set_time_axis, time_axis

        unit = "second" if c.series[2] == "SECOND" else "frame"
        x = set_time_axis(x, time_axis(start=c.series[0], step=c.series[1], n=c.data.shape[1], unit=unit))
    return x


def read(spark: SparkSession, path: str, **more) -> Dataset:  # noqa: ANN003
    """By the file's name."""
    how = {"cifti": read_cifti, "nifti": read_image, "mgh": read_image, "gifti": read_gifti, "freesurfer": read_freesurfer}
    return how[format_of(path)](spark, path, **more)


def write(x: Dataset, path: str, **more) -> None:  # noqa: ANN003
    {"nifti": write_image, "mgh": write_image, "gifti": write_gifti}[format_of(path)](x, path, **more)


def atomic(path: str, body: bytes, overwrite: bool = False) -> None:
    """All of a file or nothing: written beside it and renamed."""
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(body)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


# --- raw matrices, read by ranges


@dataclass
class Rows(InputPartition):
    start: int
    stop: int


class RawMatrix(DataSource):
    """``spark.read.format("raw_matrix")``: a row-major binary matrix on a path that all executors mount.

    Options: path, rows, columns, dtype (numpy), offset, slope, intercept, block
    (rows of a partition), frames (comma-separated columns), size (bytes expected).
    Only the asked rows and columns are read; the size is checked before.
    """

    @classmethod
    def name(cls) -> str:
        return "raw_matrix"

    def schema(self) -> str:
        return "ord long, layer_ord int, value double"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return RawReader(dict(self.options))


class RawReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.rows, self.columns = options["path"].removeprefix("file://"), int(options["rows"]), int(options["columns"])
        self.kind, self.offset = np.dtype(options.get("dtype", "<f8")), int(options.get("offset", 0))
        self.slope, self.intercept = float(options.get("slope", 1)), float(options.get("intercept", 0))
        self.block, self.size = int(options.get("block", 65_536)), options.get("size")
        self.frames = [int(f) for f in options["frames"].split(",")] if options.get("frames") else None

    def partitions(self) -> list[Rows]:
        expected = self.offset + self.rows * self.columns * self.kind.itemsize
        if os.path.getsize(self.path) < expected or self.size and os.path.getsize(self.path) != int(self.size):
            raise ValueError("the file's size has changed")
        return [Rows(a, min(a + self.block, self.rows)) for a in range(0, self.rows, self.block)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        width = self.columns * self.kind.itemsize
        with open(self.path, "rb") as f:
            f.seek(self.offset + partition.start * width)
            data = np.frombuffer(f.read((partition.stop - partition.start) * width), self.kind).reshape(-1, self.columns)
        chosen = range(self.columns) if self.frames is None else self.frames
        at = np.arange(partition.start, partition.stop)
        for n, c in enumerate(chosen):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), n, dtype=np.int32)), pa.array(data[:, c].astype(float) * self.slope + self.intercept)], names=["ord", "layer_ord", "value"])


def raw_values(spark: SparkSession, path: str, rows: int, columns: int, **options) -> DataFrame:  # noqa: ANN003
    spark.dataSource.register(RawMatrix)
    reader = spark.read.format("raw_matrix").option("path", path).option("rows", rows).option("columns", columns)
    for k, v in options.items():
        reader = reader.option(k, ",".join(map(str, v)) if isinstance(v, list | tuple) else str(v))
    return reader.load()


def copy_raw(source: str, target: str, overwrite: bool = False, block: int = 1 << 20) -> None:
    """A whole raw file elsewhere, in blocks, byte for byte."""
    if os.path.exists(target) and not overwrite or os.path.abspath(source) == os.path.abspath(target):
        raise FileExistsError(target)
    part = f"{target}.{uuid.uuid4().hex}"
    with open(source, "rb") as a, open(part, "wb") as b:
        shutil.copyfileobj(a, b, block)
    os.replace(part, target)


