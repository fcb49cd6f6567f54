"""Packing of values into bytes, dates as microseconds, and sample data with closed forms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import ArrayError, dtype
from . import geometry as G


def pack(values, name: str) -> bytes:
    """Numbers as little-endian bytes of an element type; integers are rounded half away from zero and must fit."""
    d = dtype(name)
    x = np.asarray(values)
    if d.kind in ("int", "uint") and x.dtype.kind == "f":
        x = np.sign(x) * np.floor(np.abs(x) + 0.5)
    if d.kind in ("int", "uint") and x.size:
        info = np.iinfo(d.numpy)
        if int(x.min()) < info.min or int(x.max()) > info.max:
            raise ArrayError("out_of_range", name)
    return x.astype(d.numpy).tobytes()


def unpack(data: bytes, name: str) -> np.ndarray:
    d = dtype(name)
    if len(data) % d.itemsize:
        raise ArrayError("size_mismatch", f"{len(data)} bytes of {name}")
    if d.kind == "bool":
        return np.frombuffer(data, dtype=np.uint8) != 0
    return np.frombuffer(data, dtype=d.numpy)


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a time stamp."""
    return F.unix_micros(c.cast("timestamp"))


def from_micros(c: Column) -> Column:
    return F.timestamp_micros(c)


def parse_time(c: Column) -> Column:
    """Microseconds of an ISO 8601 string, null where it isn't one."""
    return F.unix_micros(F.try_to_timestamp(c))


def matrix(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """Cells with value 1000 * row + column."""
    return G.grid(spark, (rows, columns)).withColumn("value", F.col("d0") * 1000 + F.col("d1"))


def random_floats(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Cells of values in [0, 1) that only position and seed decide."""
    return G.grid(spark, (n,)).withColumn("value", F.pmod(F.xxhash64("d0", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30))


CORPUS = ["Arrays are stored in chunks.", "Each chunk is compressed by itself.", "A slice reads only the chunks it touches.", "Missing chunks read as the fill value.", "Groups hold arrays and other groups."]


def human(seconds: float) -> str:
    for size, unit in ((1.0, "s"), (1e-3, "ms")):
        if seconds >= size:
            return f"{seconds / size:.2f} {unit}"
    return f"{seconds * 1e6:.0f} us"
