"""Stored arrays as a Spark data source (format ``gridloom``), and their writer.

Reading plans one partition for a run of chunks; filters on coordinates prune chunks
before they are opened (needs spark.sql.python.filterPushdown.enabled, which scan()
sets). A partition reads, decodes and emits Arrow batches of cells.
Writing encodes each chunk in the task that groups it and puts it under its key.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions import geometry as G
from ..operators.mutate import checked_chunks, complete_chunks, overlay, to_cells
from ..spec import ArrayError, ArraySpec, dtype
from . import codecs as C
from . import keys
from . import metadata as M
from .store import Store, kind_of, open_store


def read_spec(store: Store, prefix: str = "") -> ArraySpec:
    """Version 3 first, then version 2; attributes of version 2 come from their own document."""
    at = f"{prefix}/" if prefix else ""
    for name in (M.NODE_V3, M.ARRAY_V2):
        text = store.get(at + name)
        if text is not None:
            spec = M.from_json(text.decode())
            if name == M.ARRAY_V2 and (attrs := store.get(at + M.ATTRS_V2)):
                object.__setattr__(spec, "attributes", json.loads(attrs))
            return spec
    raise ArrayError("metadata_not_found", prefix)


def write_spec(store: Store, spec: ArraySpec, prefix: str = "") -> None:
    at = f"{prefix}/" if prefix else ""
    store.put(at + M.filename(spec.version), M.to_json(spec).encode())
    if spec.version == 2 and spec.attributes:
        store.put(at + M.ATTRS_V2, json.dumps(spec.attributes, indent=2).encode())


def _same_store(store: Store, spec: ArraySpec, path: str, backend: str | None, prefix: str = "") -> None:
    """For tasks: a directory in which the array's metadata can't be seen isn't the driver's; its chunks would pass for absent."""
    at = f"{prefix}/" if prefix else ""
    if kind_of(path, backend) == "directory" and store.get(at + M.filename(spec.version)) is None:
        raise ArrayError("store_not_shared", f"{path}: an executor doesn't see the array that the driver does")


def pipeline(spec: ArraySpec) -> C.Pipeline:
    return C.Pipeline.parse(list(spec.codecs) or M.default_codecs(spec))


def _stored_shape(spec: ArraySpec, index: tuple[int, ...]) -> tuple[int, ...]:
    """Regular chunks are stored whole, edges padded with fill; irregular ones as they are."""
    return spec.chunks if spec.irregular is None else spec.chunk_shape(index)


def encode_chunk(spec: ArraySpec, index: tuple[int, ...], values: np.ndarray) -> bytes:
    whole = np.full(_stored_shape(spec, index), spec.fill, dtype=dtype(spec.dtype).numpy)
    whole[tuple(slice(0, n) for n in values.shape)] = values
    if spec.order == "F":
        whole = np.ascontiguousarray(whole.T)
    return pipeline(spec).encode(whole)


def decode_chunk(spec: ArraySpec, index: tuple[int, ...], data: bytes) -> np.ndarray:
    shape = _stored_shape(spec, index)
    x = pipeline(spec).decode(data, dtype(spec.dtype).numpy, shape[::-1] if spec.order == "F" else shape)
    x = x.T if spec.order == "F" else x
    return x[tuple(slice(0, n) for n in spec.chunk_shape(index))]


def chunk_place(spec: ArraySpec, index: tuple[int, ...]) -> tuple[str, tuple[int, ...] | None]:
    """(key, index inside the shard or None)."""
    if spec.shard is None:
        return keys.encode(index, spec.version), None
    outer = tuple(i // s for i, s in zip(index, spec.shard, strict=True))
    return keys.encode(outer, spec.version), index


def read_chunk(store: Store, spec: ArraySpec, index: tuple[int, ...], prefix: str = "") -> np.ndarray | None:
    """A decoded chunk clipped to the array, or None where it isn't stored."""
    key, inner = chunk_place(spec, index)
    data = store.get(f"{prefix}/{key}" if prefix else key)
    if data is None:
        return None
    if inner is not None:
        data = C.shard_decode(data).get(inner)
        if data is None:
            return None
    return decode_chunk(spec, index, data)


def _arrow(values: np.ndarray, kind: str) -> pa.Array:
    flat = np.ascontiguousarray(values).ravel()
    if kind == "datetime":
        return pa.array(flat.astype("i8"), pa.timestamp("us", tz="UTC"))
    if kind == "complex":
        return pa.StructArray.from_arrays([pa.array(flat.real.astype("f8")), pa.array(flat.imag.astype("f8"))], names=["re", "im"])
    if kind == "uint":
        if flat.dtype.itemsize == 8:
            return pa.array([int(v) for v in flat], pa.decimal128(20, 0))
        return pa.array(flat.astype({1: "i2", 2: "i4", 4: "i8"}[flat.dtype.itemsize]))
    return pa.array(flat)


class ChunkPartition(InputPartition):
    def __init__(self, first: int, last: int, grid: list[tuple[int, int]], wanted: list[tuple[int, int]]):
        self.first, self.last, self.grid, self.wanted = first, last, grid, wanted

    def indices(self, shard: tuple[int, ...] | None) -> Iterator[tuple[int, ...]]:
        for n in range(self.first, self.last):
            at = []
            for lo, hi in reversed(self.grid):
                n, i = divmod(n, hi - lo + 1)
                at.append(lo + i)
            at = tuple(reversed(at))
            if shard is None:
                yield at
            else:
                yield from product(*[range(max(lo, a * s), min(hi, a * s + s - 1) + 1) for a, s, (lo, hi) in zip(at, shard, self.wanted, strict=True)])


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.backend, self.prefix = options["path"], options.get("backend"), options.get("prefix", "")
        self.per = int(options.get("chunksPerPartition", 64))
        self.absent = options.get("absent", "skip")
        self.spec = read_spec(open_store(self.path, self.backend), self.prefix)
        self.bounds = [[0, n] for n in self.spec.shape]

    def pushFilters(self, filters: list) -> Iterator:
        """Bounds on coordinates choose chunks; Spark still applies every filter itself."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else ""
            if name in self.spec.coords and isinstance(getattr(f, "value", None), int):
                b = self.bounds[self.spec.coords.index(name)]
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    b[0] = max(b[0], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    b[1] = min(b[1], f.value + (not isinstance(f, LessThan)))
            yield f

    def partitions(self) -> list[ChunkPartition]:
        """Ranges of numbers in the grid of wanted chunks (of wanted shards, where an array has them); a task makes the indices itself."""
        lists = G.overlapping(self.spec, [tuple(b) for b in self.bounds])
        if self.spec.shard is not None:
            grid = [(lo // s, hi // s) for (lo, hi), s in zip(lists, self.spec.shard, strict=True)]
            per = max(1, self.per // math.prod(self.spec.shard))
        else:
            grid, per = lists, self.per
        total = math.prod(max(0, hi - lo + 1) for lo, hi in grid)
        return [ChunkPartition(i, min(i + per, total), grid, lists) for i in range(0, total, per)] or [ChunkPartition(0, 0, grid, lists)]

    def read(self, partition: ChunkPartition):
        store, spec = open_store(self.path, self.backend), self.spec
        _same_store(store, spec, self.path, self.backend, self.prefix)
        held: tuple[str, dict] | None = None
        for index in partition.indices(spec.shard):
            key, inner = chunk_place(spec, index)
            at = f"{self.prefix}/{key}" if self.prefix else key
            if inner is not None:
                if held is None or held[0] != at:
                    data = store.get(at)
                    held = (at, C.shard_decode(data) if data is not None else {})
                data = held[1].get(inner)
            else:
                data = store.get(at)
            if data is None and self.absent == "skip":
                continue
            x = np.full(spec.chunk_shape(index), spec.fill, dtype=dtype(spec.dtype).numpy) if data is None else decode_chunk(spec, index, data)
            start = [a for a, _ in spec.chunk_bounds(index)]
            grid = np.indices(x.shape).reshape(spec.ndim, -1)
            yield pa.RecordBatch.from_arrays([*(pa.array((g + s).astype("i8")) for g, s in zip(grid, start, strict=True)), _arrow(x, dtype(spec.dtype).kind)], names=[*spec.coords, "value"])


class ChunkedSource(DataSource):
    """Options: path, backend, prefix (array inside the store), chunksPerPartition, absent (skip or fill)."""

    @classmethod
    def name(cls) -> str:
        return "gridloom"

    def schema(self):
        return read_spec(open_store(self.options["path"], self.options.get("backend")), self.options.get("prefix", "")).schema

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(self.options)


def _reachable(spark: SparkSession, path: str, backend: str | None) -> None:
    """A directory of one machine isn't one store on a cluster: its executors would write and read each their own."""
    if kind_of(path, backend) == "directory" and spark.sparkContext.master.split("[")[0] != "local" and not path.startswith("file:/"):
        raise ArrayError("local_store_on_cluster", f"{path}: name a file system that all executors share, or file:// for one mounted on all of them")


def scan(spark: SparkSession, path: str, **options) -> DataFrame:
    """Cells of a stored array."""
    _reachable(spark, path, options.get("backend"))
    spark.dataSource.register(ChunkedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # a reader that takes filters is refused without it
    return spark.read.format("gridloom").options(**{k: str(v) for k, v in options.items()}).load(path)


def write(cells: DataFrame, spec: ArraySpec, path: str, backend: str | None = None, prefix: str = "", sparse: bool = True) -> DataFrame:
    """Stores an array and returns (key, bytes) of what was written. Chunks without cells aren't stored if ``sparse``. Runs when this is called.

    Chunks are encoded and put by the tasks that hold them; a task that runs twice puts
    the same object again. Archives and memory live in one process, so their chunks
    come to the driver, shard by shard.
    """
    spark = cells.sparkSession
    _reachable(spark, path, backend)
    store = open_store(path, backend)
    write_spec(store, spec, prefix)
    wanted = G.with_chunks(cells.select(*spec.coords, "value"), spec)
    unit = spec.shard or tuple(1 for _ in spec.shape)
    wanted = wanted.withColumns({f"s{i}": G.floor_div(f"c{i}", s) for i, s in enumerate(unit)})
    if not sparse:
        every = G.grid(spark, spec.num_chunks, "c").withColumns({f"s{i}": G.floor_div(f"c{i}", s) for i, s in enumerate(unit)})
        wanted = every.join(wanted, [*spec.chunk_coords, *[f"s{i}" for i in range(spec.ndim)]], "left")
    local = kind_of(path, backend) in ("directory", "filesystem")  # tasks put their chunks themselves
    kind = dtype(spec.dtype)

    def encode(table: pa.Table) -> tuple[str, bytes]:
        at = tuple(table.column(f"s{i}")[0].as_py() for i in range(spec.ndim))
        c = np.stack([table.column(f"c{i}").to_numpy() for i in range(spec.ndim)])
        if kind.kind == "complex":
            value = np.array([complex(v["re"], v["im"]) if v else spec.fill for v in table.column("value").to_pylist()], dtype=kind.numpy)
        elif kind.kind == "datetime":
            value = table.column("value").cast(pa.timestamp("us")).cast(pa.int64()).fill_null(0).to_numpy().astype(kind.numpy)
        else:
            value = np.array([spec.fill if v is None else v for v in table.column("value").to_pylist()], dtype=kind.numpy)
        out: dict[tuple[int, ...], bytes] = {}
        for index in sorted(set(map(tuple, c.T.tolist()))):
            here = (c == np.array(index)[:, None]).all(axis=0)
            x = np.full(spec.chunk_shape(index), spec.fill, dtype=kind.numpy)
            d = [table.column(k).to_numpy(zero_copy_only=False)[here] for k in spec.coords]
            ok = ~np.isnan(d[0].astype("f8"))
            start = [a for a, _ in spec.chunk_bounds(index)]
            x[tuple((v[ok] - s).astype("i8") for v, s in zip(d, start, strict=True))] = value[here][ok]
            out[index] = encode_chunk(spec, index, x)
        key = keys.encode(at, spec.version)
        key = f"{prefix}/{key}" if prefix else key
        return key, C.shard_encode(out) if spec.shard is not None else next(iter(out.values()))

    def put(table: pa.Table) -> pa.Table:
        key, data = encode(table)
        if local:
            here = open_store(path, backend)
            _same_store(here, spec, path, backend, prefix)
            here.put(key, data)
            return pa.table({"key": [key], "bytes": pa.array([len(data)], pa.int64()), "data": pa.array([None], pa.binary())})
        return pa.table({"key": [key], "bytes": pa.array([len(data)], pa.int64()), "data": pa.array([data], pa.binary())})

    done = wanted.groupBy(*[f"s{i}" for i in range(spec.ndim)]).applyInArrow(put, "key string, bytes long, data binary")
    rows = []
    for r in done.drop("data").collect() if local else done.toLocalIterator():  # an iterator would run one task after the other
        if not local:
            store.put(r.key, bytes(r.data))
        rows.append((r.key, r.bytes))
    return spark.createDataFrame(rows, "key string, bytes long")


# The native layout: a Parquet table of dense chunks, partitioned by the leading chunk coordinate. Chunks without cells aren't stored.
def write_chunk_table(cells: DataFrame, spec: ArraySpec, path: str, mode: str = "overwrite") -> None:
    complete_chunks(cells, spec).write.mode(mode).partitionBy("c0").parquet(path)


def read_chunk_table(spark: SparkSession, spec: ArraySpec, path: str, bounds: list[tuple[int, int]] | None = None) -> DataFrame:
    """Cells with c0.., restricted to the chunks that a region overlaps; the restriction prunes partitions. Cells of chunks that aren't stored are absent."""
    from ..operators.select import pruned

    chunks = spark.read.parquet(path)
    chunks = chunks.select(*[F.col(c).cast("long").alias(c) if c != "c0" else F.col(c) for c in spec.chunk_coords], "data")
    return to_cells(checked_chunks(pruned(chunks, spec, bounds) if bounds else chunks, spec), spec)


def update_chunk_table(patch: DataFrame, spec: ArraySpec, path: str, bounds: list[tuple[int, int]]) -> None:
    """Region write on the Parquet layout: only partitions whose chunks overlap the region are rewritten.

    A chunk that isn't stored yet becomes one of fill with the patch in it. Chunks that
    were written for another shape and would be misread are an error: write the table
    anew after a resize that changes the size of a stored chunk. One writer at a time.
    """
    spark = patch.sparkSession
    lo, hi = G.overlapping(spec, bounds)[0]
    chunks = spark.read.parquet(path).where(F.col("c0").between(lo, hi))
    old = to_cells(checked_chunks(chunks.select(*[F.col(c).cast("long").alias(c) for c in spec.chunk_coords], "data"), spec), spec)
    part = f"{path.rstrip('/')}_part-{uuid.uuid4().hex}"
    complete_chunks(overlay(old, patch, spec), spec).write.parquet(part)  # the overwritten files are also read
    spark.read.parquet(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("c0").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(part)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def convert(spark: SparkSession, source: str, target: str, version: int, backend: str | None = None, target_backend: str | None = None) -> ArraySpec:
    """Copies an array into the other format version; chunks are decoded and encoded anew. Absent chunks stay absent."""
    spec = read_spec(open_store(source, backend))
    new = spec if spec.version == version else M.v2_to_v3(spec) if version == 3 else M.v3_to_v2(spec)
    options = {"backend": backend} if backend else {}
    write(scan(spark, source, **options), new, target, target_backend)
    return new


def stored_chunks(spark: SparkSession, path: str, backend: str | None = None, prefix: str = "") -> DataFrame:
    """(key, c0..) of the chunks (or shards) present, in either version's layout."""
    store = open_store(path, backend)
    spec = read_spec(store, prefix)
    at = f"{prefix}/" if prefix else ""
    found = [k[len(at) :] for k in store.keys() if k.startswith(at)]
    rows = [(k, *keys.decode(k, spec.version)) for k in found if keys.valid(k, spec.version) and len(keys.decode(k, spec.version)) == spec.ndim]
    return spark.createDataFrame(rows, "key string, " + ", ".join(f"c{i} long" for i in range(spec.ndim)))


def total_bytes(spec: ArraySpec) -> int:
    return math.prod(spec.num_chunks) * spec.chunk_size_bytes
