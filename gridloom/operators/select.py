"""Array selection as predicates on coordinate columns, with results moved to the origin.

Every selection emits the predicate on the element coordinates and, where the cells
come with chunk coordinates (c0..), the derived predicate on those too, so that a
table partitioned by chunk is pruned before it is read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import indexing as I
from ..spec import ArrayError, ArraySpec


def _all(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def pruned(cells: DataFrame, spec: ArraySpec, bounds: Sequence[tuple[int, int]]) -> DataFrame:
    """The predicate on chunk coordinates that bounds on element coordinates imply."""
    have = set(cells.columns)
    terms = []
    for i, (lo, hi) in enumerate(G.overlapping(spec, bounds)):
        if f"c{i}" in have:
            terms.append(F.col(f"c{i}").between(lo, hi))
    return cells.where(_all(terms)) if terms else cells


def box(cells: DataFrame, spec: ArraySpec, bounds: Sequence[tuple[int, int]]) -> DataFrame:
    """Cells of a half-open region, at the region's own coordinates."""
    inside = _all([(F.col(d) >= a) & (F.col(d) < b) for d, (a, b) in zip(spec.coords, bounds, strict=True)])
    return pruned(cells, spec, bounds).where(inside).select(*[(F.col(d) - a).alias(d) for d, (a, _) in zip(spec.coords, bounds, strict=True)], "value")


def strided(cells: DataFrame, spec: ArraySpec, slices: Sequence[I.Slice]) -> DataFrame:
    """Cells of slices with steps of either sign; coordinates count steps. An empty slice gives no rows."""
    terms, coords, bounds = [], [], []
    for d, (a, b, s), n in zip(spec.coords, slices, spec.shape, strict=True):
        if s == 0:
            raise ArrayError("invalid_step", "0")
        if s > 0:
            terms.append((F.col(d) >= a) & (F.col(d) < b) & (F.pmod(F.col(d) - a, F.lit(s)) == 0))
            coords.append(G.floor_div(F.col(d) - a, s).alias(d))
            bounds.append((min(a, n), max(a, min(b, n))))
        else:
            terms.append((F.col(d) <= a) & (F.col(d) > b) & (F.pmod(F.lit(a) - F.col(d), F.lit(-s)) == 0))
            coords.append(G.floor_div(F.lit(a) - F.col(d), -s).alias(d))
            bounds.append((max(b + 1, 0), max(b + 1, min(a + 1, n))))
    return pruned(cells, spec, bounds).where(_all(terms)).select(*coords, "value")


def named(cells: DataFrame, spec: ArraySpec, **by_name) -> DataFrame:
    return strided(cells, spec, I.named_slices(spec, by_name))


def squeeze(cells: DataFrame, spec: ArraySpec, items: Sequence) -> DataFrame:
    """A mixed selection of integers and slices: dimensions taken by an integer drop out, the others are renumbered."""
    parsed = I.parse_slice_spec(items, spec.shape)
    slices = [(x, x + 1, 1) if isinstance(x, int) else x for x in parsed]
    keep = [i for i, x in enumerate(parsed) if not isinstance(x, int)]
    return strided(cells, spec, slices).select(*[F.col(f"d{i}").alias(f"d{k}") for k, i in enumerate(keep)], "value")


#: Rows of a request that are sent to all tasks; larger requests are joined by shuffle.
SMALL_REQUEST = 100_000


def _request(cells: DataFrame, rows: list[tuple], columns: list[str]) -> DataFrame:
    out = cells.sparkSession.createDataFrame(rows, ", ".join(f"{c} long" for c in columns))
    return F.broadcast(out) if len(rows) <= SMALL_REQUEST else out


def _missing(spec: ArraySpec) -> Column:
    return F.coalesce(F.col("value"), F.lit(spec.fill)).alias("value")


def points(cells: DataFrame, spec: ArraySpec, indices: Sequence[Sequence[int]]) -> DataFrame:
    """Pointwise selection, one row (pos, value) for each requested point in request order, repeats included; absent cells are fill."""
    wanted = I.fancy_points(indices, spec.shape)
    request = _request(cells, [(p, *x) for p, x in enumerate(wanted)], ["pos", *spec.coords])
    if not wanted:
        return request.select("pos", F.lit(None).cast(cells.schema["value"].dataType).alias("value"))
    bounds = [(min(c), max(c) + 1) for c in zip(*wanted, strict=True)]
    near = pruned(cells, spec, bounds).where(_all([F.col(d).between(a, b - 1) for d, (a, b) in zip(spec.coords, bounds, strict=True)])).select(*spec.coords, "value")
    # The request is the small side: it is joined to the cells, and points without a cell are added from the request alone.
    hit = near.join(request, spec.coords)
    return request.select("pos").join(hit.select("pos", "value"), "pos", "left").select("pos", _missing(spec))


def orthogonal(cells: DataFrame, spec: ArraySpec, indices: Sequence[Sequence[int]]) -> DataFrame:
    """The product of one index list per dimension, at positions in the lists."""
    if len(indices) != spec.ndim:
        raise ArrayError("dimension_mismatch", f"{len(indices)} index lists for {spec.ndim} dimensions")
    lists = [[I.normalize_index(i, n) for i in x] for x, n in zip(indices, spec.shape, strict=True)]
    bounds = [(min(x, default=0), max(x, default=-1) + 1) for x in lists]
    out = pruned(cells, spec, bounds).select(*spec.coords, "value")
    for i, x in enumerate(lists):
        out = out.join(_request(cells, list(enumerate(x)), [f"p{i}", f"d{i}"]), f"d{i}")
    found = out.select(*[F.col(f"p{i}").alias(f"d{i}") for i in range(spec.ndim)], "value")
    return densify(found, tuple(len(x) for x in lists), spec.fill) if all(lists) else found


def masked(cells: DataFrame, spec: ArraySpec, mask: DataFrame, absent: bool = False) -> DataFrame:
    """Cells where mask (d0.., m) is true: (flat, value), flat being the row-major position that orders the result. ``absent`` ones come as fill if asked for."""
    on = mask.where("m").select(*spec.coords)
    if absent:
        inside = on.where(_all([F.col(c).between(0, n - 1) for c, n in zip(spec.coords, spec.shape, strict=True)]))
        return inside.join(cells.select(*spec.coords, "value"), spec.coords, "left").select(G.flat_index(spec.coords, spec.shape).alias("flat"), F.coalesce("value", F.lit(spec.fill)).alias("value"))
    return cells.join(on, spec.coords, "left_semi").select(G.flat_index(spec.coords, spec.shape).alias("flat"), "value")


def where_value(cells: DataFrame, spec: ArraySpec, predicate: Column) -> DataFrame:
    """A mask computed from values is a plain filter."""
    return cells.where(predicate).select(G.flat_index(spec.coords, spec.shape).alias("flat"), "value")


def numbered(selected: DataFrame, spec: ArraySpec) -> DataFrame:
    """(flat, value) -> (pos, value): dense positions in row-major order. Counts are taken per chunk-sized range of flat positions, so no window sees the whole array."""
    from pyspark.sql import Window

    width = max(1, spec.size // max(1, spec.total_chunks))
    part = selected.withColumn("part", G.floor_div(F.col("flat"), width))
    counts = part.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row per part: at most the number of chunks.
    before = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("flat"))
    return part.withColumn("rank", rank).join(before.select("part", "base"), "part").select((F.col("base") + F.col("rank") - 1).cast("long").alias("pos"), "value")


def blocks(spec: ArraySpec, spark, bounds: Sequence[tuple[int, int]]) -> DataFrame:
    """One row per chunk that overlaps a region: c0.. and clamped bounds; none for a region without cells."""
    chunks = G.chunk_grid(spark, spec)
    return chunks.where(_all([F.col(f"c{i}").between(lo, hi) for i, (lo, hi) in enumerate(G.overlapping(spec, bounds))]) if all(a < b for a, b in bounds) else F.lit(False))


def densify(cells: DataFrame, shape: Sequence[int], fill) -> DataFrame:
    """All cells of a shape; absent ones are fill."""
    coords = [f"d{i}" for i in range(len(shape))]
    return G.grid(cells.sparkSession, shape).join(cells, coords, "left").select(*coords, F.coalesce("value", F.lit(fill)).alias("value"))


def transpose(cells: DataFrame, order: Sequence[int]) -> DataFrame:
    if sorted(order) != list(range(len(order))):
        raise ArrayError("invalid_transpose", str(order))
    return cells.select(*[F.col(f"d{o}").alias(f"d{i}") for i, o in enumerate(order)], "value")
