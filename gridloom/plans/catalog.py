"""Hierarchies of arrays and groups: a catalogue of nodes by path, kept in a store or as a DataFrame."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import metadata as M
from ..sources.chunked import write_spec
from ..sources.store import Store, open_store
from ..spec import ArrayError, ArraySpec

NODES = "path string, parent string, name string, kind string, depth int, meta string, attrs map<string,string>"


@dataclass
class Node:
    path: str
    kind: str
    spec: ArraySpec | None = None
    attrs: dict = field(default_factory=dict)

    @property
    def parent(self) -> str:
        return self.path.rpartition("/")[0]

    @property
    def name(self) -> str:
        return self.path.rpartition("/")[2]

    @property
    def depth(self) -> int:
        return self.path.count("/") + 1 if self.path else 0


def _clean(path: str) -> str:
    parts = [p for p in path.split("/") if p]
    if any(p in (".", "..") for p in parts):
        raise ArrayError("invalid_path", path)
    return "/".join(parts)


class Catalog:
    """Groups and arrays below a root; the nodes here are what counts, the store follows them."""

    def __init__(self, store: Store | None = None, version: int = 2):
        self.store, self.version = store, version
        self.nodes: dict[str, Node] = {"": Node("", "group")}
        self._save(self.nodes[""])

    @classmethod
    def open(cls, path: str, backend: str | None = None, consolidated: bool = True) -> Catalog:
        """All nodes of a store, from its consolidated document where there is one."""
        store = open_store(path, backend)
        out = cls.__new__(cls)
        out.store, out.version, out.nodes = store, 2, {"": Node("", "group")}
        found = read_consolidated(store) if consolidated else None
        docs = found if found is not None else {k: json.loads(store.get(k)) for k in store.keys() if k.rpartition("/")[2] in (M.ARRAY_V2, M.GROUP_V2, M.ATTRS_V2, M.NODE_V3)}
        if not docs:
            raise ArrayError("group_not_found", path)
        for key in sorted(docs, key=lambda k: (k.endswith(M.ATTRS_V2), k)):
            at, _, name = key.rpartition("/")
            doc = docs[key]
            if name == M.ATTRS_V2:
                if at in out.nodes:
                    out.nodes[at].attrs.update(doc)
                continue
            array = name == M.ARRAY_V2 or doc.get("node_type") == "array"
            out._parents(at)
            out.nodes[at] = Node(at, "array" if array else "group", M.from_json(json.dumps(doc)) if array else None, dict(doc.get("attributes") or {}))
        return out

    def _save(self, node: Node) -> None:
        if self.store is None:
            return
        at = f"{node.path}/" if node.path else ""
        if node.kind == "array":
            write_spec(self.store, node.spec, node.path)
        elif self.version == 3:
            self.store.put(at + M.NODE_V3, json.dumps({"zarr_format": 3, "node_type": "group", "attributes": node.attrs}, indent=2).encode())
        else:
            self.store.put(at + M.GROUP_V2, json.dumps({"zarr_format": 2}, indent=2).encode())
        if node.attrs and self.version == 2:
            self.store.put(at + M.ATTRS_V2, json.dumps(node.attrs, indent=2).encode())

    def _parents(self, path: str) -> None:
        parts = path.split("/")[:-1]
        for i in range(1, len(parts) + 1):
            self.require_group("/".join(parts[:i]))

    def require_group(self, path: str) -> Node:
        """The group at a path, made with all above it where it isn't there."""
        path = _clean(path)
        node = self.nodes.get(path)
        if node is not None:
            if node.kind == "array":
                raise ArrayError("path_is_array", path)
            return node
        self._parents(path)
        node = self.nodes[path] = Node(path, "group")
        self._save(node)
        return node

    create_group = require_group

    def create_array(self, path: str, spec: ArraySpec) -> Node:
        path = _clean(path)
        if not path or path in self.nodes:
            raise ArrayError("node_exists", path)
        self._parents(path)
        node = self.nodes[path] = Node(path, "array", spec, dict(spec.attributes))
        self._save(node)
        return node

    def batch_create(self, arrays: dict[str, ArraySpec]) -> list[Node]:
        """All or none."""
        for p in arrays:
            if _clean(p) in self.nodes:
                raise ArrayError("node_exists", p)
        return [self.create_array(p, s) for p, s in arrays.items()]

    def __getitem__(self, path: str) -> Node:
        path = _clean(path)
        if path not in self.nodes:
            raise ArrayError("not_found", path)
        return self.nodes[path]

    def __setitem__(self, path: str, spec: ArraySpec) -> None:
        self.remove(path)
        self.create_array(path, spec)

    def __contains__(self, path: str) -> bool:
        return _clean(path) in self.nodes

    def get(self, path: str, default=None):
        return self.nodes.get(_clean(path), default)

    def pop(self, path: str) -> Node:
        node = self[path]
        self.remove(path)
        return node

    def remove(self, path: str) -> None:
        """The node and all below it, in the catalogue only; stored chunks stay."""
        path = _clean(path)
        for p in [p for p in self.nodes if p and (p == path or p.startswith(path + "/"))]:
            del self.nodes[p]

    def _below(self, path: str, kind: str) -> list[str]:
        path = _clean(path)
        return sorted(n.name for n in self.nodes.values() if n.path and n.parent == path and n.kind == kind)

    def arrays(self, path: str = "") -> list[str]:
        return self._below(path, "array")

    def groups(self, path: str = "") -> list[str]:
        return self._below(path, "group")

    def set_attr(self, path: str, key: str, value) -> None:
        node = self[path]
        node.attrs[key] = value
        if node.spec is not None:
            node.spec.attributes[key] = value
        self._save(node)

    def get_attr(self, path: str, key: str):
        attrs = self[path].attrs
        if attrs.get(key) is None:
            raise ArrayError("not_found", key)
        return attrs[key]

    def tree(self, path: str = "", depth: int | None = None, shapes: bool = True) -> str:
        """Arrays before groups, each by name."""
        lines = ["/" + _clean(path)]

        def walk(at: str, lead: str, level: int) -> None:
            if depth is not None and level >= depth:
                return
            below = [(n, "array") for n in self.arrays(at)] + [(n, "group") for n in self.groups(at)]
            for i, (name, kind) in enumerate(below):
                end = i == len(below) - 1
                full = f"{at}/{name}" if at else name
                node = self.nodes[full]
                lines.append(lead + ("└── " if end else "├── ") + name + (f" {node.spec.shape} {node.spec.dtype}" if shapes and node.spec else ""))
                if kind == "group":
                    walk(full, lead + ("    " if end else "│   "), level + 1)

        walk(_clean(path), "", 0)
        return "\n".join(lines)

    def dataframe(self, spark: SparkSession) -> DataFrame:
        rows = [(n.path, n.parent, n.name, n.kind, n.depth, M.to_json(n.spec) if n.spec else None, {k: json.dumps(v) for k, v in n.attrs.items()}) for n in sorted(self.nodes.values(), key=lambda n: n.path) if n.path]
        return spark.createDataFrame(rows, NODES)


def consolidate(store: Store, recursive: bool = True) -> dict:
    """One document with all metadata documents, written next to them."""
    found = {}
    for k in sorted(store.keys()):
        at, _, name = k.rpartition("/")
        if name in (M.ARRAY_V2, M.GROUP_V2, M.ATTRS_V2, M.NODE_V3) and (recursive or at.count("/") == 0):
            found[k] = json.loads(store.get(k))
    store.put(M.CONSOLIDATED, json.dumps({"zarr_consolidated_format": 1, "metadata": found}, indent=2).encode())
    return found


def read_consolidated(store: Store) -> dict | None:
    text = store.get(M.CONSOLIDATED)
    return None if text is None else json.loads(text)["metadata"]


def remove_consolidated(store: Store) -> None:
    store.delete(M.CONSOLIDATED)


def children(nodes: DataFrame, parent: str, kind: str | None = None) -> DataFrame:
    """Nodes directly below a path, as a query on the catalogue table."""
    out = nodes.where(F.col("parent") == parent)
    return out if kind is None else out.where(F.col("kind") == kind)
