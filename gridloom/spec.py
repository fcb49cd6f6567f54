"""Array descriptions: shape, chunks, element type, fill value and encoding, validated once on the driver."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import types as T


class ArrayError(ValueError):
    """A request that an array can't serve; ``code`` names the reason."""

    def __init__(self, code: str, text: str = ""):
        super().__init__(f"{code}: {text}" if text else code)
        self.code = code


@dataclass(frozen=True)
class DType:
    name: str
    itemsize: int
    v2: str
    numpy: str
    spark: T.DataType
    kind: str

    @property
    def signed(self) -> bool:
        return self.kind == "int"


_PAIR = T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])
#: Unsigned types are widened, uint64 to a decimal; dates and durations are microseconds.
DTYPES: dict[str, DType] = {
    d.name: d
    for d in (
        DType("int8", 1, "|i1", "i1", T.ByteType(), "int"),
        DType("int16", 2, "<i2", "<i2", T.ShortType(), "int"),
        DType("int32", 4, "<i4", "<i4", T.IntegerType(), "int"),
        DType("int64", 8, "<i8", "<i8", T.LongType(), "int"),
        DType("uint8", 1, "|u1", "u1", T.ShortType(), "uint"),
        DType("uint16", 2, "<u2", "<u2", T.IntegerType(), "uint"),
        DType("uint32", 4, "<u4", "<u4", T.LongType(), "uint"),
        DType("uint64", 8, "<u8", "<u8", T.DecimalType(20, 0), "uint"),
        DType("float32", 4, "<f4", "<f4", T.FloatType(), "float"),
        DType("float64", 8, "<f8", "<f8", T.DoubleType(), "float"),
        DType("bool", 1, "|b1", "?", T.BooleanType(), "bool"),
        DType("complex64", 8, "<c8", "<c8", _PAIR, "complex"),
        DType("complex128", 16, "<c16", "<c16", _PAIR, "complex"),
        DType("datetime64", 8, "<M8", "<i8", T.TimestampType(), "datetime"),
        DType("timedelta64", 8, "<m8", "<i8", T.LongType(), "timedelta"),
    )
}
_BY_V2 = {d.v2[1:]: d for d in DTYPES.values()}


def dtype(name: str) -> DType:
    if name not in DTYPES:
        raise ArrayError("unsupported_dtype", str(name))
    return DTYPES[name]


def dtype_from_v2(text: str) -> tuple[DType, bool]:
    """(type, big-endian) of a version-2 type string; a unit in brackets must be microseconds."""
    m = re.fullmatch(r"([<>|])([a-zA-Z]\d+)(?:\[(\w+)\])?", text)
    if not m or m[2] not in _BY_V2 or m[3] not in (None, "us"):
        raise ArrayError("unsupported_dtype", text)
    return _BY_V2[m[2]], m[1] == ">"


def is_integer(name: str) -> bool:
    return dtype(name).kind in ("int", "uint")


def is_signed(name: str) -> bool:
    return dtype(name).kind == "int"


def is_unsigned(name: str) -> bool:
    return dtype(name).kind == "uint"


def is_float(name: str) -> bool:
    return dtype(name).kind == "float"


def is_complex(name: str) -> bool:
    return dtype(name).kind == "complex"


def is_temporal(name: str) -> bool:
    return dtype(name).kind in ("datetime", "timedelta")


def is_bool(name: str) -> bool:
    return dtype(name).kind == "bool"


_NAME = re.compile(r"[A-Za-z0-9_-]+")


def fill_number(value: Any, kind: str) -> Any:
    """The fill value of metadata as a Python value: null counts as zero, NaN and infinities may be spelled out."""
    if value is None:
        return False if kind == "bool" else 0
    if isinstance(value, str):
        words = {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}
        if value not in words:
            raise ArrayError("invalid_fill_value", value)
        return words[value]
    return value


@dataclass(frozen=True)
class ArraySpec:
    shape: tuple[int, ...]
    chunks: tuple[int, ...] | None = None
    dtype: str = "float64"
    compressor: str = "zstd"
    level: int | None = None
    fill_value: Any = 0
    version: int = 2
    names: tuple[str | None, ...] | None = None
    filters: tuple[dict, ...] = ()
    codecs: tuple[dict, ...] = ()
    #: Chunk sizes along each dimension, where they aren't regular.
    irregular: tuple[tuple[int, ...], ...] | None = None
    #: Chunks per shard along each dimension.
    shard: tuple[int, ...] | None = None
    attributes: dict = field(default_factory=dict)
    order: str = "C"
    big_endian: bool = False

    def __post_init__(self) -> None:
        if not self.shape:
            raise ArrayError("shape_required")
        if any(not isinstance(n, (int, np.integer)) or n <= 0 for n in self.shape):
            raise ArrayError("invalid_shape", str(self.shape))
        if self.irregular is not None:
            if len(self.irregular) != self.ndim or any(sum(s) != n or min(s) <= 0 for s, n in zip(self.irregular, self.shape, strict=True)):
                raise ArrayError("invalid_chunk_grid", "sizes along a dimension must add up to its length")
            if self.chunks is None:
                object.__setattr__(self, "chunks", tuple(max(s) for s in self.irregular))
        if self.chunks is None:
            raise ArrayError("chunks_required")
        if len(self.chunks) != self.ndim:
            raise ArrayError("dimension_mismatch", "chunks and shape differ in rank")
        if any(c <= 0 for c in self.chunks):
            raise ArrayError("invalid_chunks", str(self.chunks))
        dtype(self.dtype)
        if self.version not in (2, 3):
            raise ArrayError("unsupported_version", str(self.version))
        if self.names is not None:
            known = [n for n in self.names if n is not None]
            if len(self.names) != self.ndim:
                raise ArrayError("dimension_names_mismatch")
            if any(not _NAME.fullmatch(n) for n in known):
                raise ArrayError("invalid_dimension_name", str(known))
            if len(set(known)) != len(known):
                raise ArrayError("duplicate_dimension_names", str(known))
        if self.order not in ("C", "F"):
            raise ArrayError("invalid_order", self.order)

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def itemsize(self) -> int:
        return dtype(self.dtype).itemsize

    @property
    def coords(self) -> list[str]:
        return [f"d{i}" for i in range(self.ndim)]

    @property
    def chunk_coords(self) -> list[str]:
        return [f"c{i}" for i in range(self.ndim)]

    @property
    def strides(self) -> tuple[int, ...]:
        return strides(self.shape)

    @property
    def num_chunks(self) -> tuple[int, ...]:
        if self.irregular is not None:
            return tuple(len(s) for s in self.irregular)
        return tuple(-(-n // c) for n, c in zip(self.shape, self.chunks, strict=True))

    @property
    def total_chunks(self) -> int:
        return math.prod(self.num_chunks)

    @property
    def chunk_size_bytes(self) -> int:
        return math.prod(self.chunks) * self.itemsize

    @property
    def fill(self) -> Any:
        return fill_number(self.fill_value, dtype(self.dtype).kind)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.LongType()) for c in self.coords] + [T.StructField("value", dtype(self.dtype).spark)])

    def with_shape(self, shape: tuple[int, ...]) -> ArraySpec:
        """The same array with another shape; an irregular grid keeps its sizes and covers growth with one more chunk."""
        grid = self.irregular
        if grid is not None:
            grid = tuple(_cover(s, n) for s, n in zip(grid, shape, strict=True))
        return replace(self, shape=tuple(shape), irregular=grid)

    def chunk_bounds(self, index: tuple[int, ...]) -> list[tuple[int, int]]:
        """Half-open bounds of a chunk, clamped to the shape."""
        out = []
        for i, c in enumerate(index):
            if not 0 <= c < self.num_chunks[i]:
                raise ArrayError("out_of_bounds", f"chunk {index}")
            if self.irregular is not None:
                a = sum(self.irregular[i][:c])
                out.append((a, a + self.irregular[i][c]))
            else:
                out.append((c * self.chunks[i], min((c + 1) * self.chunks[i], self.shape[i])))
        return out

    def chunk_shape(self, index: tuple[int, ...]) -> tuple[int, ...]:
        return tuple(b - a for a, b in self.chunk_bounds(index))

    def dimension(self, name: str) -> int:
        if self.names is None or name not in self.names:
            raise ArrayError("unknown_dimension", name)
        return self.names.index(name)


def _cover(sizes: tuple[int, ...], n: int) -> tuple[int, ...]:
    out, left = [], n
    for s in sizes:
        if left <= 0:
            break
        out.append(min(s, left))
        left -= s
    return tuple(out + [left] * (left > 0))


def strides(shape: tuple[int, ...]) -> tuple[int, ...]:
    """Row-major strides in elements."""
    out = [1] * len(shape)
    for i in range(len(shape) - 2, -1, -1):
        out[i] = out[i + 1] * shape[i + 1]
    return tuple(out)
