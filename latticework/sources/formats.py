"""Decoders and encoders of imaging files, from bytes to arrays and back.

NIfTI-1/2 volumes, MGH/MGZ volumes, GIFTI and CIFTI-2 XML, and the surface, curv
and annot files of surface reconstructions. Fixed values (offsets, codes, magic
numbers) are those of the public format definitions.
"""

from __future__ import annotations

import base64
import gzip
import struct
import xml.etree.ElementTree as ET
import zlib
from dataclasses import dataclass, field

import numpy as np

#: NIfTI data types.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
#: MGH data types, big-endian.
MGH_TYPES = {0: ">u1", 1: ">i4", 3: ">f4", 4: ">i2"}
GIFTI_TYPES = {"NIFTI_TYPE_UINT8": "u1", "NIFTI_TYPE_INT32": "i4", "NIFTI_TYPE_FLOAT32": "f4", "NIFTI_TYPE_FLOAT64": "f8"}
GIFTI_INTENTS = ("NIFTI_INTENT_POINTSET", "NIFTI_INTENT_TRIANGLE", "NIFTI_INTENT_LABEL", "NIFTI_INTENT_SHAPE", "NIFTI_INTENT_TIME_SERIES", "NIFTI_INTENT_NONE")
SURFACE_MAGIC, CURV_MAGIC = b"\xff\xff\xfe", b"\xff\xff\xff"


@dataclass
class Image:
    """Values (i, j, k, frame) with the affine that was chosen and both that were given."""

    data: np.ndarray
    affine: np.ndarray
    sform: np.ndarray | None = None
    qform: np.ndarray | None = None
    step: float = 1.0
    extensions: list[tuple[int, bytes]] = field(default_factory=list)
    intent: int = 0


def _plain(raw: bytes) -> bytes:
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def quaternion_affine(b: float, c: float, d: float, offset: np.ndarray, zooms: np.ndarray, sign: float) -> np.ndarray:
    a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
    r = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r * (zooms * [1, 1, sign or 1]), offset
    return out


def read_nifti(raw: bytes, affine: str = "auto", frames: list[int] | None = None) -> Image:
    """A NIfTI-1 or -2 single file; only the asked frames are decoded."""
    raw = _plain(raw)
    for order in "<>":
        size = struct.unpack(order + "i", raw[:4])[0]
        if size in (348, 540):
            break
    else:
        raise ValueError("not a NIfTI file")
    if size == 348:
        dim = struct.unpack(order + "8h", raw[40:56])
        intent, code = struct.unpack(order + "hh", raw[68:72])
        pix = struct.unpack(order + "8f", raw[76:108])
        offset, slope, inter = struct.unpack(order + "fff", raw[108:120])
        qcode, scode = struct.unpack(order + "hh", raw[252:256])
        q, s = struct.unpack(order + "6f", raw[256:280]), struct.unpack(order + "12f", raw[280:328])
        head = 348
    else:
        code = struct.unpack(order + "h", raw[12:14])[0]
        dim = struct.unpack(order + "8q", raw[16:80])
        pix = struct.unpack(order + "8d", raw[104:168])
        offset = struct.unpack(order + "q", raw[168:176])[0]
        slope, inter = struct.unpack(order + "dd", raw[176:192])
        qcode, scode = struct.unpack(order + "ii", raw[344:352])
        q, s = struct.unpack(order + "6d", raw[352:400]), struct.unpack(order + "12d", raw[400:496])
        intent = struct.unpack(order + "i", raw[504:508])[0]
        head = 540
    if code not in NIFTI_TYPES:
        raise ValueError(f"unsupported NIfTI data type {code}")
    shape = [max(1, int(v)) for v in dim[1 : dim[0] + 1]]
    kind = np.dtype(order + NIFTI_TYPES[code])
    count = int(np.prod(shape))
    if len(raw) < int(offset) + count * kind.itemsize:
        raise ValueError("the file is shorter than its header says")
    block = int(np.prod(shape[:3]))
    if dim[0] <= 4:
        total = count // block
        chosen = range(total) if frames is None else frames
        parts = [np.frombuffer(raw, kind, block, int(offset) + f * block * kind.itemsize) for f in chosen]
        data = np.stack(parts, axis=-1).reshape([*shape[:3], *[1] * (3 - len(shape[:3])), len(parts)], order="F").astype(float)
    else:
        data = np.frombuffer(raw, kind, count, int(offset)).reshape(shape, order="F").astype(float)
    if slope and np.isfinite(slope):
        data = data * slope + inter
    zooms = np.array(pix[1:4])
    sform = np.vstack([np.array(s).reshape(3, 4), [0, 0, 0, 1]]) if scode > 0 else None
    qform = quaternion_affine(*q[:3], np.array(q[3:6]), zooms, pix[0]) if qcode > 0 else None
    chosen = {"sform": sform, "qform": qform}.get(affine) if affine != "auto" else sform if sform is not None else qform
    if chosen is None:
        if affine != "auto":
            raise ValueError(f"the file has no {affine}")
        chosen = np.diag([*zooms, 1.0])
    extensions, at = [], head + 4
    if raw[head : head + 1] not in (b"", b"\0"):
        while at + 8 <= offset:
            size, kind_ = struct.unpack(order + "ii", raw[at : at + 8])
            if size < 8:
                break
            extensions.append((kind_, raw[at + 8 : at + size]))
            at += size
    return Image(data, chosen, sform, qform, float(pix[4]) if dim[0] > 3 else 1.0, extensions, intent)


def write_nifti(image: Image, kind: str = "f4", compress: bool = False, version: int = 1) -> bytes:
    code = next(k for k, v in NIFTI_TYPES.items() if v == kind)
    data = image.data if image.data.ndim > 3 else image.data[..., None]
    shape = data.shape if data.ndim > 4 or data.shape[3] > 1 else data.shape[:3]
    ext = b"".join(struct.pack("<ii", (size := -(-(len(b) + 8) // 16) * 16), k) + b.ljust(size - 8, b"\0") for k, b in image.extensions)
    zooms = np.sqrt((np.asarray(image.affine)[:3, :3] ** 2).sum(0))
    dims = [len(shape), *shape, *[1] * (7 - len(shape))]
    pix = [1.0, *zooms, image.step, 1.0, 1.0, 1.0]
    rows = np.asarray(image.affine, dtype=float)[:3].ravel()
    body = np.asarray(data, dtype=kind).ravel(order="F").astype("<" + kind).tobytes()
    bits = np.dtype(kind).itemsize * 8
    if version == 1:
        head = bytearray(348)
        struct.pack_into("<i", head, 0, 348)
        struct.pack_into("<8h", head, 40, *dims)
        struct.pack_into("<hhh", head, 68, image.intent, code, bits)
        struct.pack_into("<8f", head, 76, *pix)
        struct.pack_into("<fff", head, 108, 352 + len(ext), 1.0, 0.0)
        struct.pack_into("<hh", head, 252, 0, 1)
        struct.pack_into("<12f", head, 280, *rows)
        head[344:348] = b"n+1\0"
    else:
        head = bytearray(540)
        struct.pack_into("<i", head, 0, 540)
        head[4:12] = b"n+2\0\r\n\x1a\n"
        struct.pack_into("<hh", head, 12, code, bits)
        struct.pack_into("<8q", head, 16, *dims)
        struct.pack_into("<8d", head, 104, *pix)
        struct.pack_into("<q", head, 168, 544 + len(ext))
        struct.pack_into("<dd", head, 176, 1.0, 0.0)
        struct.pack_into("<ii", head, 344, 0, 1)
        struct.pack_into("<12d", head, 400, *rows)
        struct.pack_into("<i", head, 504, image.intent)
    out = bytes(head) + (b"\1\0\0\0" if ext else b"\0\0\0\0") + ext + body
    return gzip.compress(out, mtime=0) if compress else out


def read_mgh(raw: bytes, frames: list[int] | None = None) -> Image:
    raw = _plain(raw)
    version, nx, ny, nz, nf, code = struct.unpack(">6i", raw[:24])
    if version != 1 or code not in MGH_TYPES:
        raise ValueError("not a supported MGH file")
    good = struct.unpack(">h", raw[28:30])[0]
    affine = np.diag([-1.0, 1.0, 1.0, 1.0])
    if good:
        v = struct.unpack(">15f", raw[30:90])
        scale, cosines, centre = np.array(v[:3]), np.array(v[3:12]).reshape(3, 3).T, np.array(v[12:])
        affine = np.eye(4)
        affine[:3, :3] = cosines * scale
        affine[:3, 3] = centre - affine[:3, :3] @ (np.array([nx, ny, nz]) / 2)
    kind, block = np.dtype(MGH_TYPES[code]), nx * ny * nz
    parts = [np.frombuffer(raw, kind, block, 284 + f * block * kind.itemsize) for f in (range(nf) if frames is None else frames)]
    return Image(np.stack(parts, -1).reshape((nx, ny, nz, len(parts)), order="F").astype(float), affine)


def write_mgh(image: Image, compress: bool = False) -> bytes:
    data = image.data if image.data.ndim == 4 else image.data[..., None]
    affine = np.asarray(image.affine)
    zooms = np.sqrt((affine[:3, :3] ** 2).sum(0))
    centre = affine[:3, 3] + affine[:3, :3] @ (np.array(data.shape[:3]) / 2)
    head = bytearray(284)
    struct.pack_into(">7ih15f", head, 0, 1, *data.shape, 3, 0, 1, *zooms, *(affine[:3, :3] / zooms).T.ravel(), *centre)
    out = bytes(head) + data.astype(">f4").ravel(order="F").tobytes()
    return gzip.compress(out, mtime=0) if compress else out


def read_gifti(raw: bytes) -> tuple[list[tuple[str, np.ndarray, dict[str, str]]], dict[int, tuple[str, tuple[float, ...]]]]:
    """Arrays as (intent, values, metadata), and the label table: key to name and colour."""
    root = ET.fromstring(_plain(raw))
    labels = {int(e.get("Key", e.get("Index", 0))): (e.text or "", tuple(float(e.get(c, 0)) for c in ("Red", "Green", "Blue", "Alpha"))) for e in root.iter("Label")}
    out = []
    for e in root.iter("DataArray"):
        kind = np.dtype(GIFTI_TYPES[e.get("DataType")])
        shape = [int(e.get(f"Dim{k}")) for k in range(int(e.get("Dimensionality")))]
        text, how = (e.findtext("Data") or "").strip(), e.get("Encoding")
        if how == "ASCII":
            data = np.array(text.split(), dtype=kind)
        else:
            plain = base64.b64decode(text)
            data = np.frombuffer(zlib.decompress(plain) if how.startswith("GZip") else plain, kind.newbyteorder("<" if e.get("Endian") == "LittleEndian" else ">"))
        data = data.reshape(shape, order="F" if e.get("ArrayIndexingOrder") == "ColumnMajorOrder" else "C")
        out.append((e.get("Intent"), data, {m.findtext("Name"): m.findtext("Value") for m in e.iter("MD")}))
    return out, labels


def write_gifti(arrays: list[tuple[str, np.ndarray]], labels: dict[int, tuple[str, tuple[float, ...]]] | None = None) -> bytes:
    root = ET.Element("GIFTI", Version="1.0", NumberOfDataArrays=str(len(arrays)))
    table = ET.SubElement(root, "LabelTable")
    for key, (name, rgba) in (labels or {}).items():
        ET.SubElement(table, "Label", Key=str(key), **{c: repr(float(v)) for c, v in zip(("Red", "Green", "Blue", "Alpha"), rgba, strict=True)}).text = name
    for intent, data in arrays:
        if intent not in GIFTI_INTENTS:
            raise ValueError(f"unknown intent {intent!r}")
        whole = data.dtype.kind in "iub"
        data = np.ascontiguousarray(data, "<i4" if whole else "<f8" if data.dtype == np.float64 else "<f4")
        name = {"i4": "NIFTI_TYPE_INT32", "f4": "NIFTI_TYPE_FLOAT32", "f8": "NIFTI_TYPE_FLOAT64"}[data.dtype.str[1:]]
        e = ET.SubElement(root, "DataArray", Intent=intent, DataType=name, ArrayIndexingOrder="RowMajorOrder", Dimensionality=str(data.ndim), Encoding="GZipBase64Binary", Endian="LittleEndian", ExternalFileName="", ExternalFileOffset="", **{f"Dim{k}": str(n) for k, n in enumerate(data.shape)})
        ET.SubElement(e, "Data").text = base64.b64encode(zlib.compress(data.tobytes())).decode()
    return b'<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root)


@dataclass
class Cifti:
    """Values (element, map), the brain models in order, and what the maps are."""

    data: np.ndarray
    models: list[dict]
    kind: str = "dscalar"
    names: list[str] = field(default_factory=list)
    series: tuple[float, float, str] | None = None
    labels: dict[int, tuple[str, tuple[float, ...]]] = field(default_factory=dict)
    dim: tuple[int, int, int] | None = None
    affine: np.ndarray | None = None


def read_cifti(raw: bytes) -> Cifti:
    """A dense CIFTI-2 file: contiguous brain models along columns, maps or series along rows."""
    image = read_nifti(raw)
    xml = next((b for k, b in image.extensions if k == 32), None)
    if xml is None:
        raise ValueError("no CIFTI extension")
    matrix = ET.fromstring(xml.rstrip(b"\0")).find("Matrix")
    models, names, series, labels, dim, affine, kind, next_ = [], [], None, {}, None, None, "dscalar", 0
    for m in matrix.findall("MatrixIndicesMap"):
        what = m.get("IndicesMapToDataType")
        if what == "CIFTI_INDEX_TYPE_BRAIN_MODELS":
            if (v := m.find("Volume")) is not None:
                dim = tuple(map(int, v.get("VolumeDimensions").split(",")))
                affine = np.array(v.findtext("TransformationMatrixVoxelIndicesIJKtoXYZ").split(), dtype=float).reshape(4, 4)
            for b in sorted(m.findall("BrainModel"), key=lambda b: int(b.get("IndexOffset"))):
                own = {"structure": b.get("BrainStructure"), "offset": int(b.get("IndexOffset")), "count": int(b.get("IndexCount"))}
                if own["offset"] != next_:
                    raise ValueError("brain models are not contiguous")
                next_ += own["count"]
                if b.get("ModelType") == "CIFTI_MODEL_TYPE_SURFACE":
                    own |= {"type": "surface", "vertices": np.array((b.findtext("VertexIndices") or "").split(), dtype=int), "n_vertices": int(b.get("SurfaceNumberOfVertices"))}
                else:
                    own |= {"type": "voxels", "voxels": np.array((b.findtext("VoxelIndicesIJK") or "").split(), dtype=int).reshape(-1, 3)}
                models.append(own)
        elif what == "CIFTI_INDEX_TYPE_SERIES":
            kind, scale = "dtseries", 10.0 ** int(m.get("SeriesExponent"))
            series = (float(m.get("SeriesStart")) * scale, float(m.get("SeriesStep")) * scale, m.get("SeriesUnit"))
            names = [str(n) for n in range(int(m.get("NumberOfSeriesPoints")))]
        else:
            kind = "dlabel" if what == "CIFTI_INDEX_TYPE_LABELS" else "dscalar"
            for n in m.findall("NamedMap"):
                names.append(n.findtext("MapName"))
                for e in n.iter("Label"):
                    labels[int(e.get("Key"))] = (e.text or "", tuple(float(e.get(c)) for c in ("Red", "Green", "Blue", "Alpha")))
    data = image.data.reshape(image.data.shape[-2:]).T
    if len(data) != next_:
        raise ValueError("rows and brain models differ")
    return Cifti(data, models, kind, names, series, labels, dim, affine)


def write_cifti(c: Cifti) -> bytes:
    """NIfTI-2 with the XML extension; labels are int32, others float32."""
    validate_cifti(c)
    root = ET.Element("CIFTI", Version="2")
    matrix = ET.SubElement(root, "Matrix")
    kinds = {"dscalar": ("SCALARS", 3006), "dlabel": ("LABELS", 3007), "dtseries": ("SERIES", 3002)}
    m = ET.SubElement(matrix, "MatrixIndicesMap", AppliesToMatrixDimension="0", IndicesMapToDataType=f"CIFTI_INDEX_TYPE_{kinds[c.kind][0]}")
    if c.kind == "dtseries":
        for k, v in (("NumberOfSeriesPoints", c.data.shape[1]), ("SeriesExponent", 0), ("SeriesStart", c.series[0]), ("SeriesStep", c.series[1]), ("SeriesUnit", c.series[2])):
            m.set(k, str(v))
    else:
        for name in c.names or [f"map_{k + 1}" for k in range(c.data.shape[1])]:
            own = ET.SubElement(m, "NamedMap")
            ET.SubElement(own, "MapName").text = name
            if c.kind == "dlabel":
                table = ET.SubElement(own, "LabelTable")
                for key, (text, rgba) in c.labels.items():
                    ET.SubElement(table, "Label", Key=str(key), **{n: repr(float(v)) for n, v in zip(("Red", "Green", "Blue", "Alpha"), rgba, strict=True)}).text = text
    m = ET.SubElement(matrix, "MatrixIndicesMap", AppliesToMatrixDimension="1", IndicesMapToDataType="CIFTI_INDEX_TYPE_BRAIN_MODELS")
    if c.dim is not None:
        v = ET.SubElement(m, "Volume", VolumeDimensions=",".join(map(str, c.dim)))
        ET.SubElement(v, "TransformationMatrixVoxelIndicesIJKtoXYZ", MeterExponent="-3").text = " ".join(map(repr, np.asarray(c.affine, dtype=float).ravel().tolist()))
    offset = 0
    for b in c.models:
        count = len(b["vertices"] if b["type"] == "surface" else b["voxels"])
        own = ET.SubElement(m, "BrainModel", IndexOffset=str(offset), IndexCount=str(count), BrainStructure=b["structure"], ModelType="CIFTI_MODEL_TYPE_" + b["type"].upper())
        if b["type"] == "surface":
            own.set("SurfaceNumberOfVertices", str(b["n_vertices"]))
            ET.SubElement(own, "VertexIndices").text = " ".join(map(str, b["vertices"]))
        else:
            ET.SubElement(own, "VoxelIndicesIJK").text = "\n".join(" ".join(map(str, r)) for r in b["voxels"])
        offset += count
    if offset != len(c.data):
        raise ValueError("rows and brain models differ")
    data = c.data.T[None, None, None, None]
    return write_nifti(Image(data, np.eye(4), extensions=[(32, ET.tostring(root))], intent=kinds[c.kind][1]), "i4" if c.kind == "dlabel" else "f4", version=2)


def validate_cifti(c: Cifti) -> None:
    """What each kind asks for before it is written."""
    if c.kind not in ("dscalar", "dlabel", "dtseries"):
        raise ValueError(f"unknown kind {c.kind!r}")
    if c.kind == "dlabel":
        if (c.data != np.round(c.data)).any() or not set(np.unique(c.data).astype(int)) <= set(c.labels):
            raise ValueError("labels must be whole keys of the table")
        if any(not 0 <= v <= 1 for _, rgba in c.labels.values() for v in rgba):
            raise ValueError("colours lie in [0, 1]")
    if c.kind == "dtseries" and (c.series is None or c.series[2] not in ("SECOND", "HERTZ", "METER", "RADIAN")):
        raise ValueError("a series has start, step and a known unit")


def read_surface(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles of a reconstruction's surface file."""
    if raw[:3] != SURFACE_MAGIC:
        raise ValueError("not a triangle surface")
    at = raw.index(b"\n\n", 3) + 2
    nv, nf = struct.unpack(">ii", raw[at : at + 8])
    v = np.frombuffer(raw, ">f4", 3 * nv, at + 8).reshape(-1, 3).astype(float)
    return v, np.frombuffer(raw, ">i4", 3 * nf, at + 8 + 12 * nv).reshape(-1, 3).astype(np.int64)


def write_surface(vertices: np.ndarray, faces: np.ndarray, note: str = "created by latticework") -> bytes:
    return SURFACE_MAGIC + note.encode() + b"\n\n" + struct.pack(">ii", len(vertices), len(faces)) + np.asarray(vertices, ">f4").tobytes() + np.asarray(faces, ">i4").tobytes()


def read_curv(raw: bytes) -> np.ndarray:
    if raw[:3] != CURV_MAGIC:
        raise ValueError("not a new-style curv file")
    n, _, per = struct.unpack(">iii", raw[3:15])
    return np.frombuffer(raw, ">f4", n * per, 15).astype(float).reshape(n, per)


def write_curv(values: np.ndarray, n_faces: int = 0) -> bytes:
    return CURV_MAGIC + struct.pack(">iii", len(values), n_faces, 1) + np.asarray(values, ">f4").tobytes()


def read_annot(raw: bytes) -> tuple[np.ndarray, dict[int, tuple[str, tuple[int, ...]]]]:
    """Label keys of the vertices, and names with colours by key."""
    n = struct.unpack(">i", raw[:4])[0]
    pairs = np.frombuffer(raw, ">i4", 2 * n, 4).reshape(-1, 2)
    out = np.zeros(n, dtype=np.int64)
    out[pairs[:, 0]] = pairs[:, 1]
    at, names = 4 + 8 * n, {}
    if at + 4 <= len(raw) and struct.unpack(">i", raw[at : at + 4])[0]:
        at += 4
        version, _, size = struct.unpack(">iii", raw[at : at + 12])
        if version != -2:
            raise ValueError("an old colour table")
        at += 12 + size
        entries, at = struct.unpack(">i", raw[at : at + 4])[0], at + 4
        for _ in range(entries):
            _, size = struct.unpack(">ii", raw[at : at + 8])
            text, at = raw[at + 8 : at + 8 + size].rstrip(b"\0").decode(), at + 8 + size
            rgba = struct.unpack(">4i", raw[at : at + 16])
            at += 16
            names[rgba[0] + (rgba[1] << 8) + (rgba[2] << 16)] = (text, rgba)
    return out, names


def write_annot(keys: np.ndarray, names: dict[int, tuple[str, tuple[int, ...]]]) -> bytes:
    pairs = np.column_stack([np.arange(len(keys)), keys]).astype(">i4").tobytes()
    table = b"".join(struct.pack(">ii", k, len(t) + 1) + t.encode() + b"\0" + struct.pack(">4i", *rgba) for k, (t, rgba) in enumerate(names.values()))
    return struct.pack(">i", len(keys)) + pairs + struct.pack(">iiii", 1, -2, len(names), 1) + b"\0" + struct.pack(">i", len(names)) + table
