"""Chunk geometry as column expressions: everything stays inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import ArraySpec, strides


def floor_div(c: Column | str, n: int | Column) -> Column:
    """Division of integers rounded down, in integers throughout; n is positive."""
    c = F.col(c) if isinstance(c, str) else c
    n = n if isinstance(n, Column) else F.lit(n)
    return F.call_function("div", c - F.pmod(c, n), n).cast("long")


def chunk_index(spec: ArraySpec, i: int) -> Column:
    """Chunk number of coordinate d{i}: a division, or a case over the boundaries of an irregular dimension."""
    d = F.col(f"d{i}")
    if spec.irregular is None:
        return floor_div(d, spec.chunks[i])
    out, end = None, 0
    for k, size in enumerate(spec.irregular[i]):
        end += size
        out = F.when(d < end, F.lit(k)) if out is None else out.when(d < end, F.lit(k))
    return out.cast("long")


def chunk_start(spec: ArraySpec, i: int, c: Column | None = None) -> Column:
    c = F.col(f"c{i}") if c is None else c
    if spec.irregular is None:
        return c * spec.chunks[i]
    starts = [sum(spec.irregular[i][:k]) for k in range(len(spec.irregular[i]))]
    return F.get(F.array(*[F.lit(s).cast("long") for s in starts]), c.cast("int"))


def chunk_stop(spec: ArraySpec, i: int, c: Column | None = None) -> Column:
    c = F.col(f"c{i}") if c is None else c
    if spec.irregular is None:
        return F.least((c + 1) * spec.chunks[i], F.lit(spec.shape[i]).cast("long"))
    stops = [sum(spec.irregular[i][: k + 1]) for k in range(len(spec.irregular[i]))]
    return F.get(F.array(*[F.lit(s).cast("long") for s in stops]), c.cast("int"))


def with_chunks(cells: DataFrame, spec: ArraySpec) -> DataFrame:
    return cells.withColumns({f"c{i}": chunk_index(spec, i) for i in range(spec.ndim)})


def flat_index(coords: Sequence[str], shape: Sequence[int]) -> Column:
    """Row-major position of coordinates."""
    out = F.lit(0).cast("long")
    for c, s in zip(coords, strides(tuple(shape)), strict=True):
        out = out + F.col(c) * s
    return out


def unflatten(flat: Column, shape: Sequence[int]) -> list[Column]:
    """Coordinates of a row-major position."""
    return [F.pmod(floor_div(flat, s), F.lit(n)).cast("long") for s, n in zip(strides(tuple(shape)), shape, strict=True)]


def grid(spark: SparkSession, shape: Sequence[int], prefix: str = "d") -> DataFrame:
    """All coordinates of a shape from one range, without a join."""
    total = 1
    for n in shape:
        total *= n
    return spark.range(total).select(*[c.alias(f"{prefix}{i}") for i, c in enumerate(unflatten(F.col("id"), shape))])


def chunk_grid(spark: SparkSession, spec: ArraySpec) -> DataFrame:
    """One row per chunk: c0.., and its clamped bounds start0, stop0, ..."""
    out = grid(spark, spec.num_chunks, "c")
    return out.select(*spec.chunk_coords, *[x for i in range(spec.ndim) for x in (chunk_start(spec, i).cast("long").alias(f"start{i}"), chunk_stop(spec, i).cast("long").alias(f"stop{i}"))])


def overlapping(spec: ArraySpec, bounds: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Inclusive chunk range along each dimension that overlaps a region; first > last where it is empty."""
    out = []
    for i, (a, b) in enumerate(bounds):
        if a >= b:
            out.append((0, -1))
        elif spec.irregular is None:
            out.append((a // spec.chunks[i], (b - 1) // spec.chunks[i]))
        else:
            ends = [sum(spec.irregular[i][: k + 1]) for k in range(len(spec.irregular[i]))]
            out.append((next(k for k, e in enumerate(ends) if a < e), next(k for k, e in enumerate(ends) if b - 1 < e)))
    return out


def chunk_key(index: Sequence[Column], version: int = 2) -> Column:
    """The storage key of a chunk: 0.1.2, or c/0/1/2."""
    parts = [c.cast("string") for c in index]
    return F.concat_ws(".", *parts) if version == 2 else F.concat_ws("/", F.lit("c"), *parts)


def key_valid(key: Column, ndim: int, version: int = 2) -> Column:
    number = r"(0|[1-9][0-9]*)"
    pattern = rf"^{number}(\.{number}){{{ndim - 1}}}$" if version == 2 else rf"^c(/{number}){{{ndim}}}$"
    return key.rlike(pattern)


def key_index(key: Column, ndim: int, version: int = 2) -> Column:
    """Chunk index of a key as an array, null where the key isn't one."""
    body = key if version == 2 else F.substring_index(key, "c/", -1)
    parts = F.transform(F.split(body, r"\." if version == 2 else "/"), lambda x: x.try_cast("long"))
    return F.when(key_valid(key, ndim, version), parts)
