"""Writes as relational overlays: a patch replaces the cells at its coordinates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import indexing as I
from ..spec import ArrayError, ArraySpec


def overlay(cells: DataFrame, patch: DataFrame, spec: ArraySpec) -> DataFrame:
    """cells with those of patch in their place; patch has each coordinate once."""
    columns = [*spec.coords, "value"]
    return cells.select(*columns).join(patch.select(*spec.coords), spec.coords, "left_anti").unionByName(patch.select(*columns))


def set_region(cells: DataFrame, spec: ArraySpec, patch: DataFrame, start: Sequence[int], step: Sequence[int] | None = None) -> DataFrame:
    """patch is at its own coordinates; it lands at start + coordinate * step."""
    step = step or [1] * spec.ndim
    if any(s <= 0 for s in step):
        raise ArrayError("invalid_step", str(step))
    moved = patch.select(*[(F.col(d) * s + a).alias(d) for d, a, s in zip(spec.coords, start, step, strict=True)], "value")
    return overlay(cells, moved, spec)


def set_scalar(cells: DataFrame, spec: ArraySpec, bounds: Sequence[tuple[int, int]], value: Column) -> DataFrame:
    """Existing cells of a region with another value, without a join."""
    inside = F.lit(True)
    for d, (a, b) in zip(spec.coords, bounds, strict=True):
        inside = inside & (F.col(d) >= a) & (F.col(d) < b)
    return cells.withColumn("value", F.when(inside, value).otherwise(F.col("value")))


def resize(cells: DataFrame, spec: ArraySpec, shape: Sequence[int]) -> tuple[DataFrame, ArraySpec]:
    """Another shape of the same rank. Cells beyond it are gone for good; new ones are fill, i.e. absent."""
    if len(shape) != spec.ndim:
        raise ArrayError("dimension_mismatch", f"{len(shape)} for {spec.ndim}")
    new = spec.with_shape(tuple(shape))
    inside = F.lit(True)
    for d, n, old in zip(spec.coords, shape, spec.shape, strict=True):
        if n < old:
            inside = inside & (F.col(d) < n)
    return cells.where(inside), new


def append(cells: DataFrame, spec: ArraySpec, more: DataFrame, count: int, axis: int = 0) -> tuple[DataFrame, ArraySpec]:
    """``count`` more slabs along an axis; ``more`` is at its own coordinates."""
    if not 0 <= axis < spec.ndim:
        raise ArrayError("invalid_axis", str(axis))
    if count <= 0:
        raise ArrayError("invalid_shape", f"{count} slabs")
    shape = [n + count * (i == axis) for i, n in enumerate(spec.shape)]
    moved = more.select(*[(F.col(d) + (spec.shape[i] if i == axis else 0)).alias(d) for i, d in enumerate(spec.coords)], "value")
    return cells.select(*spec.coords, "value").unionByName(moved), spec.with_shape(tuple(shape))


def delete_chunk(cells: DataFrame, spec: ArraySpec, index: Sequence[int]) -> DataFrame:
    """Cells outside a chunk; its own read as fill from then on. Deleting an absent chunk changes nothing."""
    inside = F.lit(True)
    for d, (a, b) in zip(spec.coords, spec.chunk_bounds(tuple(index)), strict=True):
        inside = inside & (F.col(d) >= a) & (F.col(d) < b)
    return cells.where(~inside)


def region_size(bounds: Sequence[tuple[int, int]], step: Sequence[int] | None = None) -> int:
    """Elements that a write to a region needs."""
    return math.prod(I.slice_size((a, b, s)) for (a, b), s in zip(bounds, step or [1] * len(bounds), strict=True))


def to_chunks(cells: DataFrame, spec: ArraySpec) -> DataFrame:
    """Dense chunk layout: c0.., data (row-major values). Edge chunks have their clamped size."""
    from .select import densify

    dense = G.with_chunks(densify(cells.select(*spec.coords, "value"), spec.shape, spec.fill), spec)
    # Row-major order of the global position is row-major order inside a chunk.
    return dense.groupBy(*spec.chunk_coords).agg(F.array_sort(F.collect_list(F.struct(G.flat_index(spec.coords, spec.shape).alias("f"), "value"))).alias("x")).select(*spec.chunk_coords, F.col("x.value").alias("data"))


def complete_chunks(cells: DataFrame, spec: ArraySpec, chunks: DataFrame | None = None) -> DataFrame:
    """Dense chunk layout of ``chunks`` (c0.., each once), or of those that have cells; absent cells are fill. The rest of the array isn't made."""
    x = G.with_chunks(cells.select(*spec.coords, "value"), spec)
    chunks = x.select(*spec.chunk_coords).distinct() if chunks is None else chunks.select(*spec.chunk_coords)
    places = to_cells(chunks.withColumn("data", F.sequence(F.lit(0).cast("long"), _chunk_cells(spec) - 1)), spec).drop("value")
    dense = places.join(x.select(*spec.coords, "value"), spec.coords, "left").withColumn("value", F.coalesce("value", F.lit(spec.fill)))
    return dense.groupBy(*spec.chunk_coords).agg(F.array_sort(F.collect_list(F.struct(G.flat_index(spec.coords, spec.shape).alias("f"), "value"))).alias("x")).select(*spec.chunk_coords, F.col("x.value").alias("data"))


def _chunk_cells(spec: ArraySpec) -> Column:
    """Cells of the chunk at c0.., clamped to the array."""
    n = F.lit(1).cast("long")
    for i in range(spec.ndim):
        n = n * (G.chunk_stop(spec, i) - G.chunk_start(spec, i))
    return n


def checked_chunks(chunks: DataFrame, spec: ArraySpec) -> DataFrame:
    """chunks; a row whose data hasn't the size of its chunk is an error when it is read, as its cells would land elsewhere."""
    size = F.size("data").cast("long")
    return chunks.withColumn("data", F.when(size == _chunk_cells(spec), F.col("data")).otherwise(F.raise_error(F.concat(F.lit("chunk of another shape, cells: "), size.cast("string")))))


def to_cells(chunks: DataFrame, spec: ArraySpec) -> DataFrame:
    """Cell layout of dense chunks, by position inside the chunk; keeps c0.. for pruning."""
    out = chunks.select(*spec.chunk_coords, F.posexplode("data").alias("p", "value"))
    size = [G.chunk_stop(spec, i) - G.chunk_start(spec, i) for i in range(spec.ndim)]
    cols, rest = [], F.col("p").cast("long")
    for i in range(spec.ndim - 1, -1, -1):
        at = F.pmod(rest, size[i])
        cols.append((G.chunk_start(spec, i) + at).cast("long").alias(f"d{i}"))
        rest = G.floor_div(rest, size[i])
    return out.select(*reversed(cols), "value", *spec.chunk_coords)
