"""Metadata documents of stored arrays, versions 2 and 3, and conversion between them."""

from __future__ import annotations

import json
import math
from dataclasses import replace
from typing import Any

from ..functions import geometry as G  # noqa: F401  (key encoders build on its expressions)
from ..spec import DTYPES, ArrayError, ArraySpec, dtype, dtype_from_v2

ARRAY_V2, GROUP_V2, ATTRS_V2, NODE_V3, CONSOLIDATED = ".zarray", ".zgroup", ".zattrs", "zarr.json", ".zmetadata"
VERSIONS = (2, 3)


def filename(version: int, group: bool = False) -> str:
    return NODE_V3 if version == 3 else GROUP_V2 if group else ARRAY_V2


def version_of(doc: dict) -> int:
    v = doc.get("zarr_format")
    if v not in VERSIONS:
        raise ArrayError("unsupported_version", str(v))
    return v


def _fill_out(v: Any) -> Any:
    if isinstance(v, float) and not math.isfinite(v):
        return "NaN" if math.isnan(v) else "Infinity" if v > 0 else "-Infinity"
    return v


_V2_FILTERS = {"delta", "quantize", "fixedscaleoffset", "astype", "shuffle", "bitround", "packbits", "categorize"}


def to_v2(spec: ArraySpec) -> dict:
    if spec.irregular is not None:
        raise ArrayError("incompatible", "version 2 has regular chunk grids only")
    d = dtype(spec.dtype)
    return {
        "zarr_format": 2,
        "shape": list(spec.shape),
        "chunks": list(spec.chunks),
        "dtype": (">" + d.v2[1:]) if spec.big_endian else d.v2,
        "compressor": None if spec.compressor == "none" else {"id": spec.compressor, "level": 5 if spec.level is None else spec.level},
        "fill_value": _fill_out(spec.fill_value),
        "order": spec.order,
        "filters": [dict(f) for f in spec.filters] or None,
    }


def from_v2(doc: dict) -> ArraySpec:
    for key in ("shape", "chunks", "dtype"):
        if key not in doc:
            raise ArrayError("invalid_metadata", f"no {key}")
    d, big = dtype_from_v2(doc["dtype"])
    filters = tuple(dict(f) for f in doc.get("filters") or ())
    for f in filters:
        if f.get("id") not in _V2_FILTERS:
            raise ArrayError("unknown_filter", str(f.get("id")))
    c = doc.get("compressor")
    return ArraySpec(tuple(doc["shape"]), tuple(doc["chunks"]), d.name, c["id"] if c else "none", (c or {}).get("level"), doc.get("fill_value"), 2, filters=filters, order=doc.get("order", "C"), big_endian=big)


def default_codecs(spec: ArraySpec) -> list[dict]:
    """The pipeline that a version-2 style compressor and filters stand for."""
    out = [{"name": f["id"], "configuration": {k: v for k, v in f.items() if k != "id"}} for f in spec.filters if f["id"] not in ("shuffle",)]
    out.append({"name": "bytes", "configuration": {"endian": "big" if spec.big_endian else "little"}})
    out += [{"name": "shuffle", "configuration": {k: v for k, v in f.items() if k != "id"}} for f in spec.filters if f["id"] == "shuffle"]
    if spec.compressor != "none":
        out.append({"name": spec.compressor, "configuration": {} if spec.level is None or spec.compressor in ("lz4", "snappy", "bzip2") else {"level": spec.level}})
    return out


def to_v3(spec: ArraySpec) -> dict:
    codecs = list(spec.codecs) or default_codecs(spec)
    shape = list(spec.chunks)
    if spec.shard is not None:
        # The outer grid is one of shards; shard_shape counts chunks.
        codecs = [{"name": "sharding_indexed", "configuration": {"chunk_shape": shape, "shard_shape": list(spec.shard), "codecs": codecs, "index_codecs": [{"name": "bytes"}, {"name": "crc32c"}], "index_location": "end"}}]
        shape = [c * s for c, s in zip(spec.chunks, spec.shard, strict=True)]
    grid = {"name": "regular", "configuration": {"chunk_shape": shape}} if spec.irregular is None else {"name": "irregular", "configuration": {"chunk_sizes": [list(s) for s in spec.irregular]}}
    return {
        "zarr_format": 3,
        "node_type": "array",
        "shape": list(spec.shape),
        "data_type": spec.dtype,
        "chunk_grid": grid,
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        "codecs": codecs,
        "fill_value": _fill_out(spec.fill_value),
        "attributes": spec.attributes,
    } | ({"dimension_names": list(spec.names)} if spec.names else {})


def from_v3(doc: dict) -> ArraySpec:
    for key in ("shape", "data_type", "chunk_grid", "codecs", "fill_value"):
        if key not in doc:
            raise ArrayError("invalid_metadata", f"no {key}")
    if doc.get("node_type") != "array":
        raise ArrayError("invalid_node_type", str(doc.get("node_type")))
    if doc["data_type"] not in DTYPES:
        raise ArrayError("unsupported_dtype", str(doc["data_type"]))
    grid, shard, codecs, irregular, chunks = doc["chunk_grid"], None, doc["codecs"], None, None
    if grid.get("name") == "regular":
        chunks = tuple(grid["configuration"]["chunk_shape"])
    elif grid.get("name") == "irregular":
        irregular = tuple(tuple(s) for s in grid["configuration"]["chunk_sizes"])
    else:
        raise ArrayError("invalid_chunk_grid", str(grid.get("name")))
    if codecs and codecs[0]["name"] == "sharding_indexed":
        c = codecs[0]["configuration"]
        chunks, codecs = tuple(c["chunk_shape"]), c["codecs"]
        shard = tuple(c["shard_shape"])
    names = doc.get("dimension_names")
    return ArraySpec(tuple(doc["shape"]), chunks, doc["data_type"], "none", None, doc["fill_value"], 3, tuple(names) if names else None, codecs=tuple(codecs), irregular=irregular, shard=shard, attributes=doc.get("attributes") or {})


def to_json(spec: ArraySpec) -> str:
    return json.dumps(to_v3(spec) if spec.version == 3 else to_v2(spec), indent=2)


def from_json(text: str) -> ArraySpec:
    doc = json.loads(text)
    return from_v3(doc) if version_of(doc) == 3 else from_v2(doc)


def v2_to_v3(spec: ArraySpec) -> ArraySpec:
    return replace(spec, version=3, codecs=tuple(default_codecs(spec)), compressor="none", filters=())


def compatibility(spec: ArraySpec) -> tuple[str, list[str]]:
    """(ok, warning or error, reasons) for keeping an array as version 2."""
    errors = ["irregular chunk grid"] * (spec.irregular is not None) + ["sharding"] * (spec.shard is not None)
    if errors:
        return "error", errors
    lost = ["dimension names"] * bool(spec.names and any(spec.names)) + [c["name"] for c in spec.codecs if c["name"] in ("transpose", "quantize", "bitround")]
    return ("warning", lost) if lost else ("ok", [])


def v3_to_v2(spec: ArraySpec) -> ArraySpec:
    """Dimension names and the codecs that version 2 lacks drop out; chunks are encoded anew when the array is written."""
    state, reasons = compatibility(spec)
    if state == "error":
        raise ArrayError("incompatible", ", ".join(reasons))
    byte_steps = [c for c in spec.codecs if c["name"] in ("zlib", "gzip", "zstd", "lz4", "snappy", "bzip2", "blosc")]
    first = byte_steps[0] if byte_steps else None
    filters = tuple({"id": c["name"]} | dict(c.get("configuration") or {}) for c in spec.codecs if c["name"] in ("delta", "shuffle", "fixedscaleoffset", "astype"))
    name = first["name"] if first else "none"
    return replace(spec, version=2, compressor="zlib" if name == "gzip" else name, level=((first or {}).get("configuration") or {}).get("level"), filters=filters, codecs=(), names=None)
