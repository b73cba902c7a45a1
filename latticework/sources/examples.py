"""Small datasets to try things on, made from their definitions and checked against their hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from latticework.model import Dataset, Measure, point, sha256, surface, volume

#: What each example is made of.
DEFINITIONS: dict[str, dict] = {
    "tetrahedron": {"kind": "surface", "at": [[0, 0, 0], [1, 0, 0], [0.5, 0.8660254037844386, 0], [0.5, 0.2886751345948129, 0.816496580927726]], "faces": [[0, 1, 2], [0, 1, 3], [1, 2, 3], [2, 0, 3]], "values": [[10], [20], [30], [40]]},
    "point-grid": {"kind": "point", "at": [[k % 3, k // 3] for k in range(9)], "values": [[v] for v in (1, 2, 3, 2, 4, 7, 3, 7, 9)]},
    "voxels": {"kind": "volume", "dim": [3, 3, 3], "affine": [[2, 0, 0, -2], [0, 2, 0, -2], [0, 0, 2, -2], [0, 0, 0, 1]], "active": [0, 1, 4, 13], "values": [[1], [2], [5], [14]]},
}


def manifest() -> dict[str, str]:
    """Name and hash of every example."""
    return {k: sha256(v) for k, v in DEFINITIONS.items()}


def load(spark: SparkSession, name: str, expected: str | None = None) -> Dataset:
    """One example; with a hash, only if it is still the same."""
    d = DEFINITIONS[name]
    if expected is not None and sha256(d) != expected:
        raise ValueError(f"{name} has changed")
    measure = Measure("signal", "signal", support_behavior="intensive")
    make: dict[str, Callable[[], Dataset]] = {
        "surface": lambda: surface(spark, d["at"], d["faces"], d["values"], measures=measure),
        "point": lambda: point(spark, d["at"], d["values"], measures=measure),
        "volume": lambda: volume(spark, d["dim"], d["affine"], [n in d["active"] for n in range(27)], d["values"], measures=measure),
    }
    return make[d["kind"]]()
