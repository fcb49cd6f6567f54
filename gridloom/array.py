"""The array interface: a specification and a DataFrame of cells, immutable; every operation gives a new one or a query."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions import indexing as I
from .operators import batch, mutate, select
from .sources import chunked
from .sources.store import open_store
from .spec import ArrayError, ArraySpec, dtype


@dataclass(frozen=True)
class ChunkedArray:
    spec: ArraySpec
    cells: DataFrame

    @classmethod
    def create(cls, spark: SparkSession, shape: Sequence[int], chunks: Sequence[int] | None = None, **options) -> ChunkedArray:
        """An array without stored cells: everything reads as fill."""
        spec = ArraySpec(tuple(shape), None if chunks is None else tuple(chunks), **options)
        return cls(spec, spark.createDataFrame([], spec.schema))

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> ChunkedArray:
        spec = chunked.read_spec(open_store(path, options.get("backend")), options.get("prefix", ""))
        return cls(spec, chunked.scan(spark, path, **options))

    load = open

    @classmethod
    def from_numpy(cls, spark: SparkSession, values: np.ndarray, chunks: Sequence[int], **options) -> ChunkedArray:
        import pyarrow as pa

        spec = ArraySpec(values.shape, tuple(chunks), **({"dtype": values.dtype.name} | options))
        grid = np.indices(values.shape).reshape(values.ndim, -1).astype("i8")
        table = pa.table({**{d: g for d, g in zip(spec.coords, grid, strict=True)}, "value": chunked._arrow(values, dtype(spec.dtype).kind)})
        return cls(spec, spark.createDataFrame(table))

    def save(self, path: str, **options) -> DataFrame:
        """Metadata and all chunks with cells."""
        return chunked.write(self.cells, self.spec, path, **options)

    def save_metadata(self, path: str, backend: str | None = None) -> None:
        chunked.write_spec(open_store(path, backend), self.spec)

    # Properties
    @property
    def ndim(self) -> int:
        return self.spec.ndim

    @property
    def size(self) -> int:
        return self.spec.size

    @property
    def itemsize(self) -> int:
        return self.spec.itemsize

    def _with(self, shape: Sequence[int], cells: DataFrame) -> ChunkedArray:
        chunks = tuple(max(1, min(c, n)) for c, n in zip(self.spec.chunks, shape, strict=True))
        return ChunkedArray(ArraySpec(tuple(max(1, n) for n in shape), chunks, self.spec.dtype, self.spec.compressor, fill_value=self.spec.fill_value, names=self.spec.names), cells)

    # Selection
    def slice(self, start: Sequence[int] | None = None, stop: Sequence[int] | None = None, step: int | Sequence[int] | None = None) -> DataFrame:
        """Half-open region; an integer step is for dimension 0 only."""
        if step is None:
            return select.box(self.cells, self.spec, I.region(self.spec, start, stop))
        steps = [step] + [1] * (self.ndim - 1) if isinstance(step, int) else list(step)
        if any(s == 0 for s in steps):
            raise ArrayError("invalid_step", "0")
        slices = []
        for i, s in enumerate(steps):
            n = self.spec.shape[i]
            if s > 0:
                a, b = I.region(ArraySpec((n,), (n,)), None if start is None else [start[i]], None if stop is None else [stop[i]])[0]
                slices.append((a, b, s))
            else:
                # A stop of -1 means to the beginning.
                slices.append((n - 1 if start is None else I.normalize_index(start[i], n), -1 if stop is None or stop[i] == -1 else I.normalize_index(stop[i], n), s))
        return select.strided(self.cells, self.spec, slices)

    def sel(self, **named) -> DataFrame:
        return select.named(self.cells, self.spec, **named)

    def __getitem__(self, items) -> DataFrame:
        """Integers drop their dimension; slices may have steps of either sign."""
        return select.squeeze(self.cells, self.spec, items if isinstance(items, tuple) else (items,))

    def vindex(self, *indices: Sequence[int]) -> DataFrame:
        return select.points(self.cells, self.spec, indices)

    def oindex(self, *indices: Sequence[int]) -> DataFrame:
        return select.orthogonal(self.cells, self.spec, indices)

    def mask(self, mask: DataFrame) -> DataFrame:
        return select.masked(self.cells, self.spec, mask, absent=True)

    def blocks(self, start: Sequence[int] | None = None, stop: Sequence[int] | None = None) -> DataFrame:
        """Chunks that overlap a region with their bounds and dense data, each whole."""
        bounds = I.region(self.spec, start, stop)
        found = select.blocks(self.spec, self.cells.sparkSession, bounds)
        return found.join(mutate.complete_chunks(self.cells, self.spec, found), self.spec.chunk_coords)

    def dense(self) -> ChunkedArray:
        return ChunkedArray(self.spec, select.densify(self.cells.select(*self.spec.coords, "value"), self.spec.shape, self.spec.fill))

    def transpose(self, *order: int) -> ChunkedArray:
        cells = select.transpose(self.cells, order)
        spec = self.spec
        names = None if spec.names is None else tuple(spec.names[o] for o in order)
        return ChunkedArray(ArraySpec(tuple(spec.shape[o] for o in order), tuple(spec.chunks[o] for o in order), spec.dtype, spec.compressor, fill_value=spec.fill_value, names=names), cells)

    # Writes
    def set(self, patch: DataFrame, start: Sequence[int], step: Sequence[int] | None = None) -> ChunkedArray:
        return ChunkedArray(self.spec, mutate.set_region(self.cells, self.spec, patch, start, step))

    def set_numpy(self, values: np.ndarray, start: Sequence[int], step: Sequence[int] | None = None) -> ChunkedArray:
        step = step or [1] * self.ndim
        last = [a + (n - 1) * s + 1 for a, n, s in zip(start, values.shape, step, strict=True)]
        I.region(self.spec, start, last)
        patch = ChunkedArray.from_numpy(self.cells.sparkSession, values.astype(dtype(self.spec.dtype).numpy), values.shape, dtype=self.spec.dtype).cells
        return self.set(patch, start, step)

    def set_bytes(self, data: bytes, start: Sequence[int], stop: Sequence[int], step: Sequence[int] | None = None) -> ChunkedArray:
        """Row-major bytes whose number must be that of the region."""
        bounds = I.region(self.spec, start, stop)
        step = step or [1] * self.ndim
        need = mutate.region_size(bounds, step)
        if len(data) != need * self.itemsize:
            raise ArrayError("size_mismatch", f"{len(data)} bytes for {need} elements")
        if not need:
            return self
        shape = [I.slice_size((a, b, s)) for (a, b), s in zip(bounds, step, strict=True)]
        return self.set_numpy(np.frombuffer(data, dtype=dtype(self.spec.dtype).numpy).reshape(shape), start, step)

    def resize(self, *shape: int) -> ChunkedArray:
        cells, spec = mutate.resize(self.cells, self.spec, shape)
        return ChunkedArray(spec, cells)

    def append(self, values: np.ndarray, axis: int = 0) -> ChunkedArray:
        if not 0 <= axis < self.ndim:
            raise ArrayError("invalid_axis", str(axis))
        if values.ndim != self.ndim or any(a != b for i, (a, b) in enumerate(zip(values.shape, self.spec.shape, strict=True)) if i != axis):
            raise ArrayError("shape_mismatch", f"{values.shape} onto {self.spec.shape}")
        more = ChunkedArray.from_numpy(self.cells.sparkSession, values.astype(dtype(self.spec.dtype).numpy), values.shape, dtype=self.spec.dtype).cells
        cells, spec = mutate.append(self.cells, self.spec, more, values.shape[axis], axis)
        return ChunkedArray(spec, cells)

    # Streams and batches
    def stored(self) -> DataFrame:
        """Indices of chunks that have cells."""
        return G.with_chunks(self.cells, self.spec).select(*self.spec.chunk_coords).distinct()

    def chunk_stream(self, where: Callable[[tuple[int, ...]], bool] | None = None, progress: Callable[[int, int], None] | None = None) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
        """Stored chunks one after the other; a partition at a time reaches the driver."""
        chunks = G.with_chunks(self.cells, self.spec)
        rows = chunks.groupBy(*self.spec.chunk_coords).agg(F.collect_list(F.struct(*self.spec.coords, "value")).alias("x"))
        total = self.stored().count() if progress else 0
        for done, r in enumerate(rows.toLocalIterator(), 1):
            index = tuple(r[c] for c in self.spec.chunk_coords)
            if where is None or where(index):
                out = np.full(self.spec.chunk_shape(index), self.spec.fill, dtype=dtype(self.spec.dtype).numpy)
                start = [a for a, _ in self.spec.chunk_bounds(index)]
                for x in r.x:
                    out[tuple(x[d] - s for d, s in zip(self.spec.coords, start, strict=True))] = x["value"]
                yield index, out
            if progress:
                progress(done, total)

    def chunk_map(self, f: Callable[[tuple[int, ...], np.ndarray], float]) -> DataFrame:
        """(c0.., result) of a function of each stored chunk, run where the chunk is."""
        import pyarrow as pa

        spec = self.spec

        def run(table: pa.Table) -> pa.Table:
            index = tuple(table.column(c)[0].as_py() for c in spec.chunk_coords)
            x = np.full(spec.chunk_shape(index), spec.fill, dtype=dtype(spec.dtype).numpy)
            start = [a for a, _ in spec.chunk_bounds(index)]
            x[tuple(table.column(d).to_numpy() - s for d, s in zip(spec.coords, start, strict=True))] = table.column("value").to_numpy()
            return pa.table({**{c: pa.array([i], pa.int64()) for c, i in zip(spec.chunk_coords, index, strict=True)}, "result": pa.array([float(f(index, x))])})

        return G.with_chunks(self.cells, spec).groupBy(*spec.chunk_coords).applyInArrow(run, ", ".join(f"{c} long" for c in spec.chunk_coords) + ", result double")

    def batches(self, size: int, drop_remainder: bool = False) -> DataFrame:
        return batch.batches(self.cells, self.spec, size, drop_remainder)

    def shuffled(self, size: int, seed: int = 0, drop_remainder: bool = False) -> DataFrame:
        return batch.shuffled(self.cells, self.spec, size, seed, drop_remainder)

    def tiles(self, *tile: int) -> DataFrame:
        return batch.tiles(self.cells, self.spec, tile)

    # Edges of the cluster: these bring a result to the driver.
    def to_numpy(self, cells: DataFrame | None = None, shape: Sequence[int] | None = None) -> np.ndarray:
        shape = tuple(shape or self.spec.shape)
        out = np.full(shape, self.spec.fill, dtype=dtype(self.spec.dtype).numpy)
        if math.prod(shape):
            t = (self.cells if cells is None else cells).toArrow()
            value = t.column("value").to_numpy()
            out[tuple(t.column(f"d{i}").to_numpy() for i in range(len(shape)))] = value.astype(out.dtype)
        return out

    def to_bytes(self) -> bytes:
        """All cells, row-major."""
        return self.to_numpy().tobytes()
