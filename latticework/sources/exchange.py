"""Support maps as files: one Matrix Market file with a description, or a bundle of column chunks."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators.support import SupportMap
from latticework.storage import collected

from .readers import atomic

HEADER = "%%MatrixMarket matrix coordinate real general\n"


def _sha(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


#: Entries that the driver holds at a time.
SLAB = 1_000_000


def _slabs(df: DataFrame, chunk: int) -> Iterator[tuple[int, int]]:
    """Ranges of sources in order, whole chunks, of about SLAB entries at most (or one chunk)."""
    sizes = df.groupBy(F.floor(F.col("source_ord") / chunk).alias("c")).agg(F.count("*").alias("n")).toPandas().sort_values("c")
    start = held = 0
    for c, n in zip(sizes["c"].tolist(), sizes["n"].tolist(), strict=True):
        if held and held + n > SLAB:
            yield start * chunk, c * chunk
            start, held = c, 0
        held += n
    if held:
        yield start * chunk, (int(sizes["c"].iloc[-1]) + 1) * chunk


def _entries(df: DataFrame, column: str = "weight", chunk: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(targets, sources, values) in the order of sources, then targets, a slab of whole chunks at a time."""
    for start, stop in _slabs(df, chunk):
        part = df.where((F.col("source_ord") >= start) & (F.col("source_ord") < stop))
        t = collected(part.select("target_ord", "source_ord", F.col(column).cast("double").alias("v"))).sort_values(["source_ord", "target_ord"], kind="stable")
        yield t["target_ord"].to_numpy(), t["source_ord"].to_numpy(), t["v"].to_numpy()


def _lines(targets: np.ndarray, sources: np.ndarray, values: np.ndarray) -> str:
    return "".join(f"{i + 1} {j + 1} {v!r}\n" for i, j, v in zip(targets.tolist(), sources.tolist(), values.tolist(), strict=True))


def _whole(df: DataFrame, shape: tuple[int, int], column: str = "weight") -> bytes:
    n, parts = 0, []
    for t, s, v in _entries(df, column):
        n += len(t)
        parts.append(_lines(t, s, v))
    return (HEADER + f"{shape[0]} {shape[1]} {n}\n" + "".join(parts)).encode()


def _supports(m: SupportMap) -> dict[str, list]:
    """The support's columns in the order of sources, as the descriptions hold them."""
    found: list[tuple] = []
    for start, stop in _slabs(m.support, 100_000):
        found.append(collected(m.support.where((F.col("source_ord") >= start) & (F.col("source_ord") < stop)).select("source_ord", "support").orderBy("source_ord")))
    return {"source_ord": [v for t in found for v in t["source_ord"].tolist()], "source_support": [v for t in found for v in t["support"].tolist()]}


def _given(spark: SparkSession, about: dict) -> DataFrame:
    return spark.createDataFrame(pa.table({"source_ord": pa.array(about["source_ord"], pa.int64()), "support": pa.array(map(float, about["source_support"]), pa.float64())}))


def _shape(m: SupportMap) -> tuple[int, int]:
    targets = m.weights.agg(F.max("target_ord")).first()[0]
    sources = m.support.agg(F.max("source_ord")).first()[0]
    return (-1 if targets is None else targets) + 1, (-1 if sources is None else sources) + 1


def write_map(m: SupportMap, path: str, overwrite: bool = False) -> None:
    """``path``.mtx (and ``path``.var.mtx) with ``path``.json."""
    shape = _shape(m)
    atomic(f"{path}.mtx", _whole(m.weights, shape), overwrite)
    if "weight_var" in m.weights.columns:
        atomic(f"{path}.var.mtx", _whole(m.weights, shape, "weight_var"), overwrite)
    atomic(f"{path}.json", json.dumps({"schema": 1, "type": m.kind, "coverage": m.coverage, "shape": shape, **_supports(m)}).encode(), overwrite)


def _read_market(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Entries of Matrix Market files, parsed by the executors; the size line has no place of its own in a split file, so it is told by its file."""
    lines = spark.read.text(paths).where(~F.col("value").startswith("%") & (F.length(F.trim("value")) > 0)).select(F.split(F.trim("value"), r"\s+").alias("p"))
    # entries are reals: the size line is the one without a point or exponent
    real = F.col("p")[2].rlike(r"[.eEn]")
    return lines.where(real).select((F.col("p")[0].cast("long") - 1).alias("target_ord"), (F.col("p")[1].cast("long") - 1).alias("source_ord"), F.col("p")[2].cast("double").alias("weight"))


def read_map(spark: SparkSession, path: str) -> SupportMap:
    """What ``write_map`` or ``write_bundle`` has written."""
    if os.path.isdir(path) or path.endswith("manifest.json"):
        return read_bundle(spark, path.removesuffix("manifest.json"))
    with open(f"{path}.json") as f:
        about = json.load(f)
    weights = _read_market(spark, [f"{path}.mtx"])
    if os.path.exists(f"{path}.var.mtx"):
        weights = weights.join(_read_market(spark, [f"{path}.var.mtx"]).withColumnRenamed("weight", "weight_var"), ["target_ord", "source_ord"], "left")
    support = _given(spark, about)
    return SupportMap(weights, support, about["type"], about["coverage"])


def write_bundle(m: SupportMap, path: str, chunk: int = 100_000, overwrite: bool = False) -> None:
    """Chunks of source columns and a manifest with their hashes, in a folder that appears at once."""
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    part, shape, chunks = f"{path}.{uuid.uuid4().hex}", _shape(m), []
    os.makedirs(part)

    def chunked(stop: int, t: np.ndarray, s: np.ndarray, v: np.ndarray) -> None:
        """The chunks up to ``stop``, empty ones too, of entries in order."""
        while (start := len(chunks) * chunk) < stop:
            end, name = min(start + chunk, shape[1]), f"chunk-{len(chunks):05d}.mtx"
            a, z = np.searchsorted(s, [start, end])
            atomic(f"{part}/{name}", (HEADER + f"{shape[0]} {shape[1]} {z - a}\n" + _lines(t[a:z], s[a:z], v[a:z])).encode())
            chunks.append({"file": name, "start": start, "stop": end, "sha256": _sha(f"{part}/{name}"), "size": os.path.getsize(f"{part}/{name}")})

    none = np.zeros(0, dtype=np.int64)
    for t, s, v in _entries(m.weights, chunk=chunk):
        chunked(min((int(s[-1]) // chunk + 1) * chunk, shape[1]), t, s, v)
    chunked(shape[1], none, none, none)
    atomic(f"{part}/manifest.json", json.dumps({"schema": 2, "type": m.kind, "coverage": m.coverage, "shape": shape, "chunks": chunks, **_supports(m)}).encode())
    if os.path.exists(path):
        shutil.rmtree(path)
    os.rename(part, path)


def validate_bundle(path: str) -> dict:
    """The manifest, once its chunks are found in order, whole and unchanged."""
    with open(os.path.join(path, "manifest.json")) as f:
        about = json.load(f)
    at = 0
    for c in about["chunks"]:
        own = os.path.join(path, c["file"])
        if c["start"] != at or os.path.getsize(own) != c["size"] or _sha(own) != c["sha256"]:
            raise ValueError(f"{c['file']} is out of order or has changed")
        at = c["stop"]
    if at != about["shape"][1]:
        raise ValueError("the chunks do not cover the sources")
    return about


def read_bundle(spark: SparkSession, path: str) -> SupportMap:
    about = validate_bundle(path)
    weights = _read_market(spark, [os.path.join(path, c["file"]) for c in about["chunks"]])
    support = _given(spark, about)
    return SupportMap(weights, support, about["type"], about["coverage"])


def migrate(spark: SparkSession, path: str, output: str, chunk: int = 100_000, overwrite: bool = False) -> None:
    write_bundle(read_map(spark, path), output, chunk, overwrite)
