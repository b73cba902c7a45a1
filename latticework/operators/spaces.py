"""Coordinate spaces, affine transforms and the graph of both."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import functions as F

from latticework.model import Dataset, Space, sha256

#: Fields in which two spaces may only differ if they are different; the others make them incompatible.
SOFT = ("space_id", "template", "density", "resolution")


def space_hash(s: Space) -> str:
    return sha256(asdict(s))


def audit(left: Space, right: Space) -> dict[str, str]:
    """Each field: same, different or incompatible."""
    a, b = asdict(left), asdict(right)
    return {k: "same" if a[k] == b[k] else "different" if k in SOFT else "incompatible" for k in a}


@dataclass(frozen=True)
class Registry:
    """Known spaces and other names for them; adding makes a new registry."""

    spaces: tuple[Space, ...] = ()
    aliases: tuple[tuple[str, str], ...] = ()

    def register(self, space: Space, aliases: tuple[str, ...] = ()) -> Registry:
        h = space_hash(space)
        if any(a == name for a, _ in self.aliases for name in aliases):
            raise ValueError("an alias is taken")
        spaces = self.spaces if h in map(space_hash, self.spaces) else (*self.spaces, space)
        return Registry(spaces, (*self.aliases, *((a, h) for a in aliases)))

    def resolve(self, what: Space | str) -> Space:
        """An object by its hash, then an alias, a hash, or a space_id that only one space has."""
        by_hash = {space_hash(s): s for s in self.spaces}
        if isinstance(what, Space):
            return by_hash[space_hash(what)]
        for a, h in self.aliases:
            if a == what:
                return by_hash[h]
        if what in by_hash:
            return by_hash[what]
        named = [s for s in self.spaces if s.space_id == what]
        if len(named) != 1:
            raise KeyError(f"{len(named)} spaces named {what!r}")
        return named[0]


@dataclass(frozen=True)
class Transform:
    """A declared way from one space to another; only affine ones can be applied."""

    source: Space
    target: Space
    kind: str = "affine"
    matrix: tuple[tuple[float, ...], ...] | None = None
    interpolation: str = "none"
    parameters: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.kind == "affine":
            m = np.asarray(self.matrix, dtype=float)
            if m.shape != (4, 4) or not np.isfinite(m).all() or not np.allclose(m[3], [0, 0, 0, 1]):
                raise ValueError("an affine transform is a 4 x 4 matrix with the last row 0 0 0 1")
            object.__setattr__(self, "matrix", tuple(map(tuple, m.tolist())))

    def array(self) -> np.ndarray:
        if self.kind != "affine":
            raise ValueError(f"a {self.kind} transform cannot be executed")
        return np.asarray(self.matrix)

    def invert(self) -> Transform:
        return Transform(self.target, self.source, "affine", np.linalg.inv(self.array()).tolist(), self.interpolation)

    def then(self, second: Transform) -> Transform:
        if space_hash(self.target) != space_hash(second.source):
            raise ValueError("the transforms do not meet")
        return Transform(self.source, second.target, "affine", (second.array() @ self.array()).tolist())

    def hash(self) -> str:
        return sha256({"source": space_hash(self.source), "target": space_hash(self.target), "kind": self.kind, "matrix": self.matrix, "interpolation": self.interpolation, "parameters": self.parameters})


def apply(x: Dataset, t: Transform) -> Dataset:
    """Coordinates and affine in the target space."""
    if space_hash(x.space) != space_hash(t.source):
        raise ValueError("the data are in another space")
    m = t.array()
    at = [F.coalesce(c, F.lit(0.0)) for c in "xyz"]
    moved = {c: sum((float(r[k]) * at[k] for k in range(3)), F.lit(float(r[3]))) for c, r in zip("xyz", m, strict=False)}
    elements = x.elements.withColumns({c: F.when(F.col("x").isNotNull(), e) for c, e in moved.items()}).select(*x.elements.columns)
    affine = tuple(map(tuple, (m @ np.asarray(x.affine)).tolist())) if x.affine else None
    return replace(x, elements=elements, affine=affine, space=t.target).noted("transform", hash=t.hash())


@dataclass(frozen=True)
class Edge:
    id: str
    transform: Transform
    invertible: bool
    lossy: bool


@dataclass(frozen=True)
class TransformGraph:
    registry: Registry
    edges: tuple[Edge, ...] = ()

    def add(self, transform: Transform, edge_id: str, invertible: bool | None = None, lossy: bool | None = None) -> TransformGraph:
        if edge_id in {e.id for e in self.edges}:
            raise ValueError(f"edge {edge_id!r} exists")
        for s in (transform.source, transform.target):
            self.registry.resolve(s)
        inv = transform.kind == "affine" if invertible is None else invertible
        return replace(self, edges=(*self.edges, Edge(edge_id, transform, inv, transform.interpolation != "none" if lossy is None else lossy)))

    def path(self, start: Space | str, end: Space | str, allow_inverse: bool = False, selection: list[str] | None = None) -> list[tuple[str, bool]]:
        """(edge, inverted) along the only shortest way; two are an error, backward steps only over invertible lossless edges."""
        a, b = (space_hash(self.registry.resolve(s)) for s in (start, end))
        steps = [(space_hash(e.transform.source), space_hash(e.transform.target), e.id, False) for e in self.edges]
        if allow_inverse:
            steps += [(v, u, k, True) for (u, v, k, _), e in zip(steps, self.edges, strict=True) if e.invertible and not e.lossy]
        if selection is not None:
            steps = [s for s in steps if s[2] in selection]
        front, seen = [(a, [])], {a}
        while front:
            if found := [p for at, p in front if at == b]:
                if len(found) > 1:
                    raise ValueError("several shortest paths: select edges")
                return found[0]
            nxt = [(v, [*p, (k, inv)]) for at, p in front for u, v, k, inv in steps if u == at and v not in seen]
            seen |= {v for v, _ in nxt}
            front = nxt
        raise ValueError("no path")

    def composed(self, path: list[tuple[str, bool]]) -> Transform:
        by_id = {e.id: e.transform for e in self.edges}
        out = None
        for k, inverted in path:
            t = by_id[k].invert() if inverted else by_id[k]
            out = t if out is None else out.then(t)
        return out

    def diagnostics(self) -> dict[str, list]:
        """Cycles of two, parallel edges, and edges between incompatible spaces."""
        ends = [(space_hash(e.transform.source), space_hash(e.transform.target), e.id) for e in self.edges]
        return {
            "cycles": [(p, q) for n, (a, b, p) in enumerate(ends) for c, d, q in ends[n + 1 :] if (a, b) == (d, c)],
            "ambiguous": [(p, q) for n, (a, b, p) in enumerate(ends) for c, d, q in ends[n + 1 :] if (a, b) == (c, d)],
            "incompatible": [e.id for e in self.edges if "incompatible" in audit(e.transform.source, e.transform.target).values()],
        }


def apply_path(x: Dataset, graph: TransformGraph, path: list[tuple[str, bool]], authorize: bool = False) -> Dataset:
    if not authorize:
        raise PermissionError("moving data to another space changes them: authorise it")
    return apply(x, graph.composed(path)).noted("transform_path", path=[list(p) for p in path])
