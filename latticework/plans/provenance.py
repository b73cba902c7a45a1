"""Manifests, histories and replay: what was made from what, checked by hashes."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import shutil
import sys
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from latticework.model import Dataset, base_signature, canonical, logical_hash, sha256, subset
from latticework.operators import temporal

#: Name entities in their order.
ENTITIES = ("sub", "ses", "task", "acq", "ce", "rec", "dir", "run", "mod", "echo", "flip", "inv", "mt", "part", "recording", "proc", "space", "atlas", "hemi", "res", "den", "label", "desc")
#: Known file extensions.
EXTENSIONS = (".dtseries.nii", ".dscalar.nii", ".dlabel.nii", ".nii.gz", ".surf.gii", ".shape.gii", ".label.gii", ".func.gii", ".nii", ".gii", ".tsv", ".json")


def parse_name(path: str) -> dict:
    """Entities, suffix and extension of a file name; unknown, repeated or misplaced entities are errors."""
    name = os.path.basename(path)
    extension = next((e for e in sorted(EXTENSIONS, key=len, reverse=True) if name.endswith(e)), "." + name.partition(".")[2] if "." in name else "")
    *pairs, suffix = name.removesuffix(extension).split("_")
    entities, last = {}, -1
    for p in pairs:
        key, dash, value = p.partition("-")
        if not dash or not value or key not in ENTITIES:
            raise ValueError(f"unknown entity {p!r}")
        if ENTITIES.index(key) <= last:
            raise ValueError(f"entity {key!r} is repeated or out of order")
        last = ENTITIES.index(key)
        entities[key] = value
    return {"entities": entities, "suffix": suffix, "extension": extension}


def build_name(entities: dict[str, str], suffix: str, extension: str) -> str:
    if bad := set(entities) - set(ENTITIES):
        raise ValueError(f"unknown entities {sorted(bad)}")
    return "_".join([*(f"{k}-{entities[k]}" for k in ENTITIES if k in entities), suffix]) + extension


#: Fields of the description beside a derived file, and of what it says of each layer.
SIDECAR = ("Specification", "SpatialReference", "BaseType", "BaseHash", "Entities", "MeasurementSemantics", "Sources", "GeneratedBy", "History")
SEMANTICS = ("Name", "ValueType", "SpatialSemantics", "Units")


def sidecar(x: Dataset, entities: dict[str, str] | None = None, sources: list[str] | None = None) -> dict:
    """The description that goes beside a derived file."""
    layers = x.layers.join(x.measures.drop("name"), "measure_id").orderBy("layer_ord").collect()
    meant = [{"Name": r["name"], "ValueType": r["value_type"], "SpatialSemantics": r["support_behavior"], "Units": r["unit"], "LayerId": r["layer_id"], "MissingPolicy": r["missing_policy"], "Aggregation": r["aggregation"], "TemporalSemantics": r["temporal_semantics"]} for r in layers]
    return {"Specification": "derivative", "SpatialReference": x.space.space_id, "BaseType": x.kind, "BaseHash": base_signature(x), "Entities": entities or {}, "MeasurementSemantics": meant, "Sources": sources or [], "GeneratedBy": [{"Name": "latticework"}], "History": list(x.history)}


def validate_sidecar(found: dict, x: Dataset | None = None, path: str | None = None) -> list[str]:
    """What is missing, of another kind, or does not fit the data or the path."""
    issues = [f"missing {k}" for k in SIDECAR if k not in found]
    kinds = {"SpatialReference": str, "BaseType": str, "BaseHash": str, "Entities": dict, "MeasurementSemantics": list, "Sources": list, "GeneratedBy": list, "History": list}
    issues += [f"{k} is no {t.__name__}" for k, t in kinds.items() if k in found and not isinstance(found[k], t)]
    if issues:
        return issues
    issues += [f"unknown entity {k}" for k in found["Entities"] if k not in ENTITIES]
    issues += [f"layer {n} has no {k}" for n, own in enumerate(found["MeasurementSemantics"]) for k in SEMANTICS if k not in own]
    if x is not None:
        if found["BaseHash"] != base_signature(x) or found["BaseType"] != x.kind:
            issues.append("another base")
        if len(found["MeasurementSemantics"]) != x.layers.count():
            issues.append("another number of layers")
    if path is not None and parse_name(path)["entities"] != found["Entities"]:
        issues.append("the path has other entities")
    return issues


def write_derivative(x: Dataset, path: str, writer: Callable[[Dataset, str], None], entities: dict[str, str] | None = None, sources: list[str] | None = None, strict: bool = False, overwrite: bool = False) -> None:
    """Data and description together or not at all."""
    about = sidecar(x, entities, sources)
    if strict and (issues := validate_sidecar(about, x, path)):
        raise ValueError(str(issues))
    ext = parse_name(path)["extension"] if strict else next((e for e in EXTENSIONS if path.endswith(e)), "")
    beside = path.removesuffix(ext) + ".json"
    if not overwrite and (os.path.exists(path) or os.path.exists(beside)):
        raise FileExistsError(path)
    stage = os.path.join(os.path.dirname(path) or ".", f".{uuid.uuid4().hex}")
    os.makedirs(stage)
    try:
        own = os.path.join(stage, os.path.basename(path))
        writer(x, own)
        with open(os.path.join(stage, "about"), "w") as f:
            f.write(canonical(about))
        os.replace(own, path)
        try:
            os.replace(os.path.join(stage, "about"), beside)
        except OSError:
            os.remove(path)
            raise
    finally:
        shutil.rmtree(stage, ignore_errors=True)


def export_history(x: Dataset, redact: str = "none") -> list[dict]:
    """The history; ``paths`` keeps base names, ``all`` takes paths and hashes out."""
    def clean(v, key: str = ""):  # noqa: ANN001, ANN202
        if isinstance(v, dict):
            return {k: clean(w, k) for k, w in v.items() if redact != "all" or not any(s in k for s in ("path", "file", "hash", "sha256", "signature"))}
        if isinstance(v, list | tuple):
            return [clean(w, key) for w in v]
        return os.path.basename(v) if redact == "paths" and isinstance(v, str) and "/" in v else v

    return [clean(dict(h)) for h in x.history]


def object_manifest(x: Dataset) -> dict:
    body = {"kind": x.kind, "base_signature": base_signature(x), "logical_hash": logical_hash(x), "n_elements": x.elements.count(), "n_layers": x.layers.count(), "measures": [r.asDict() for r in x.measures.orderBy("measure_id").collect()], "history": list(x.history)}
    return {**body, "hash": sha256(body)}


def validate_manifest(m: dict, x: Dataset | None = None, mode: str = "report") -> list[str]:
    issues = [] if m.get("hash") == sha256({k: v for k, v in m.items() if k != "hash"}) else ["the manifest has changed"]
    if x is not None and m.get("logical_hash") != logical_hash(x):
        issues.append("the data are others")
    if issues and mode == "error":
        raise ValueError(str(issues))
    return issues


def write_json(body: dict, path: str, overwrite: bool = False) -> None:
    from latticework.sources.readers import atomic

    atomic(path, canonical(body).encode(), overwrite)


def read_json(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def history_dag(nodes: list[str], edges: list[tuple[str, str]]) -> dict:
    """A provenance graph, sorted topologically; cycles and unknown ends are errors."""
    if bad := {e for pair in edges for e in pair} - set(nodes):
        raise ValueError(f"unknown nodes {sorted(bad)}")
    left, order = {n: {a for a, b in edges if b == n} for n in nodes}, []
    while left:
        free = sorted(n for n, before in left.items() if not before & left.keys())
        if not free:
            raise ValueError("the history has a cycle")
        order += free
        for n in free:
            del left[n]
    body = {"nodes": order, "edges": sorted(map(list, edges))}
    return {**body, "hash": sha256(body)}


def validate_dag(d: dict) -> bool:
    return history_dag(d["nodes"], [tuple(e) for e in d["edges"]])["hash"] == d["hash"]


def environment() -> dict:
    import numpy
    import pyspark

    body = {"python": sys.version.split()[0], "platform": platform.platform(), "pyspark": pyspark.__version__, "numpy": numpy.__version__}
    return {**body, "hash": sha256(body)}


#: The operations that can be replayed, on datasets by name.
OPERATIONS: dict[str, Callable] = {
    "subset": lambda x, **a: subset(x, a.get("elements"), a.get("layers")),
    "time_slice": lambda x, **a: temporal.time_slice(x, a.get("index"), tuple(a["between"]) if a.get("between") else None),
    "change": lambda x, **a: _single(x, temporal.change(temporal.series(x), a["before"], a["after"], a.get("scale", "difference")), "change"),
    "trend": lambda x, **a: _single(x, temporal.trend(temporal.series(x)).selectExpr("ord", "slope as value"), "slope"),
    "contrast": lambda x, **a: _single(x, temporal.contrast(temporal.series(x), a.get("operation", "mean"), a.get("coefficients")), "contrast"),
}


def _single(x: Dataset, values, name: str) -> Dataset:  # noqa: ANN001
    from dataclasses import replace

    from pyspark.sql import functions as F

    layers = x.layers.limit(1).select(F.lit(0).alias("layer_ord"), F.lit("layer_0001").alias("layer_id"), F.lit(name).alias("name"), "measure_id")
    return replace(x, values=values.select("ord", F.lit(0).alias("layer_ord"), "value"), layers=layers, time_axis=None)


@dataclass(frozen=True)
class Step:
    id: str
    operation: str
    input: str
    arguments: dict

    def __post_init__(self):
        if self.operation not in OPERATIONS:
            raise ValueError(f"{self.operation!r} cannot be replayed")


def _run(inputs: dict[str, Dataset], steps: list[Step]) -> dict[str, Dataset]:
    known = dict(inputs)
    for s in steps:
        known[s.id] = OPERATIONS[s.operation](known[s.input], **s.arguments)
    return known


def record(inputs: dict[str, Dataset], steps: list[Step], outputs: list[str] | None = None) -> tuple[dict, dict[str, Dataset]]:
    """Run the steps and note the hashes of inputs and outputs."""
    known = _run(inputs, steps)
    outputs = outputs or [steps[-1].id]
    body = {"inputs": {k: logical_hash(v) for k, v in inputs.items()}, "steps": [vars(s) for s in steps], "outputs": {k: logical_hash(known[k]) for k in outputs}, "environment": environment()}
    return {**body, "hash": sha256(body)}, {k: known[k] for k in outputs}


def replay(manifest: dict, inputs: dict[str, Dataset], policy: str = "compatible") -> dict[str, Dataset]:
    """Run a record again; other inputs, another environment (if exact) or other outputs are errors."""
    validate_manifest(manifest, mode="error")
    if {k: logical_hash(v) for k, v in inputs.items()} != manifest["inputs"]:
        raise ValueError("the inputs are others")
    if policy == "exact" and environment()["hash"] != manifest["environment"]["hash"]:
        raise ValueError("the environment is another")
    known = _run(inputs, [Step(**s) for s in manifest["steps"]])
    for k, h in manifest["outputs"].items():
        if logical_hash(known[k]) != h:
            raise ValueError(f"{k} came out otherwise")
    return {k: known[k] for k in manifest["outputs"]}


def artifact_manifest(paths: list[str], root: str = ".", roles: dict[str, str] | None = None) -> dict:
    entries = []
    for p in sorted(paths):
        if os.path.isabs(p) or ".." in p.split("/"):
            raise ValueError(f"{p!r} leaves the folder")
        with open(os.path.join(root, p), "rb") as f:
            entries.append({"path": p, "role": (roles or {}).get(p, "data"), "size": os.path.getsize(f.name), "sha256": hashlib.file_digest(f, "sha256").hexdigest()})
    return {"entries": entries, "hash": sha256(entries)}


def validate_artifacts(m: dict, root: str | None = None, mode: str = "report") -> list[str]:
    issues = [] if m.get("hash") == sha256(m.get("entries")) else ["the manifest has changed"]
    if root is not None and not issues:
        for e in m["entries"]:
            own = os.path.join(root, e["path"])
            if not os.path.exists(own):
                issues.append(f"missing {e['path']}")
            elif artifact_manifest([e["path"]], root)["entries"][0]["sha256"] != e["sha256"]:
                issues.append(f"changed {e['path']}")
    if issues and mode == "error":
        raise ValueError(str(issues))
    return issues


def write_batch(directory: str, writers: dict[str, Callable[[str], None]], overwrite: bool = False) -> dict:
    """Files by their writers in a folder of its own, which takes its place at once; an older one is put back on failure."""
    if os.path.exists(directory) and not overwrite:
        raise FileExistsError(directory)
    stage, old = f"{directory}.{uuid.uuid4().hex}", f"{directory}.old-{uuid.uuid4().hex}"
    os.makedirs(stage)
    try:
        for name, w in writers.items():
            w(os.path.join(stage, name))
        m = artifact_manifest(list(writers), stage)
        write_json(m, os.path.join(stage, "manifest.json"))
        if os.path.exists(directory):
            os.rename(directory, old)
        os.rename(stage, directory)
    except BaseException:
        if os.path.exists(old) and not os.path.exists(directory):
            os.rename(old, directory)
        shutil.rmtree(stage, ignore_errors=True)
        raise
    shutil.rmtree(old, ignore_errors=True)
    return m


def read_batch(directory: str) -> dict:
    m = read_json(os.path.join(directory, "manifest.json"))
    validate_artifacts(m, directory, "error")
    return m
