"""Value filters as column expressions: they encode and decode without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..spec import ArrayError, ArraySpec, dtype

_RANGE = {"int8": (-(2**7), 2**7 - 1), "int16": (-(2**15), 2**15 - 1), "int32": (-(2**31), 2**31 - 1), "int64": (-(2**63), 2**63 - 1), "uint8": (0, 2**8 - 1), "uint16": (0, 2**16 - 1), "uint32": (0, 2**32 - 1), "uint64": (0, 2**64 - 1)}


def _in_chunk(spec: ArraySpec) -> Window:
    return Window.partitionBy(*spec.chunk_coords).orderBy(G.flat_index(spec.coords, spec.shape))


def delta_encode(cells: DataFrame, spec: ArraySpec) -> DataFrame:
    """First value of each chunk, then differences; windows never go beyond a chunk."""
    x = G.with_chunks(cells, spec)
    w = _in_chunk(spec)
    return x.withColumn("value", F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0).cast(cells.schema["value"].dataType))).select(*cells.columns)


def delta_decode(cells: DataFrame, spec: ArraySpec) -> DataFrame:
    x = G.with_chunks(cells, spec)
    w = _in_chunk(spec).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return x.withColumn("value", F.sum("value").over(w).cast(cells.schema["value"].dataType)).select(*cells.columns)


def clamp(c: Column, to: str) -> Column:
    lo, hi = _RANGE[to]
    return F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))).cast(dtype(to).spark)


def quantize_digits(c: Column, digits: int) -> Column:
    """Rounds half away from zero to decimal digits."""
    return F.round(c * float(10**digits), 0) / float(10**digits)


def scale_encode(c: Column, scale: float, offset: float = 0.0, to: str = "int16") -> Column:
    """round((v - offset) / scale), clamped to an integer type."""
    if scale == 0:
        raise ArrayError("invalid_scale")
    return clamp(F.round((c - offset) / scale, 0), to)


def scale_decode(c: Column, scale: float, offset: float = 0.0) -> Column:
    return c.cast("double") * scale + offset


def astype(c: Column, to: str) -> Column:
    """The value in another type: integers round towards zero and clamp, floats convert."""
    d = dtype(to)
    if d.kind in ("int", "uint"):
        return clamp(F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("double"), to)
    return c.cast(d.spark)


def bitround_magnitude(c: Column, keepbits: int) -> Column:
    """Rounds to a multiple of 2 ** (52 - keepbits)."""
    unit = float(2 ** (52 - keepbits))
    return F.round(c / unit, 0) * unit


def bitround_mantissa(c: Column, keepbits: int = 10) -> Column:
    """Clears all but the first mantissa bits of a double, by arithmetic on its power of two, so no Python is needed."""
    exponent = F.floor(F.log2(F.abs(c)))
    unit = F.pow(F.lit(2.0), exponent - keepbits)
    cut = F.signum(c) * F.floor(F.abs(c) / unit) * unit
    return F.when((c == 0) | F.isnan(c), c).otherwise(cut)
