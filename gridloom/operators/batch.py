"""Batches, shuffles, pairs and tiles of samples along axis 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..spec import ArrayError, ArraySpec


def count_batches(samples: int, size: int, drop_remainder: bool = False) -> int:
    if size <= 0:
        raise ArrayError("invalid_batch_size", str(size))
    return samples // size if drop_remainder else -(-samples // size)


def batches(cells: DataFrame, spec: ArraySpec, size: int, drop_remainder: bool = False) -> DataFrame:
    """Cells with batch and, in place of d0, the position in the batch."""
    n = count_batches(spec.shape[0], size, drop_remainder)
    rest = spec.coords[1:]
    return cells.where(F.col("d0") < n * size).select(G.floor_div("d0", size).alias("batch"), F.pmod("d0", F.lit(size)).cast("long").alias("d0"), *rest, "value")


def permutation(spark, samples: int, seed: int) -> DataFrame:
    """(d0, pos): every sample once, in an order that only the seed decides.

    Positions come from range partitions of a hash: a partition's rows are ranked by
    themselves and the partitions' sizes are added up, so no task sorts all samples.
    """
    from pyspark.sql import Window

    parts = max(1, samples // 100_000)
    x = spark.range(samples).select(F.col("id").alias("d0"), F.xxhash64("id", F.lit(seed)).alias("h"))
    x = x.withColumn("part", F.pmod(F.xxhash64("h", F.lit(seed + 1)), F.lit(parts)))
    before = x.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("h", "d0"))
    return x.withColumn("rank", rank).join(before.select("part", "base"), "part").select("d0", (F.col("base") + F.col("rank") - 1).cast("long").alias("pos"))


def shuffled(cells: DataFrame, spec: ArraySpec, size: int, seed: int, drop_remainder: bool = False) -> DataFrame:
    """Batches of the permuted samples: batch, position in it, the sample's own number, other coordinates, value."""
    n = count_batches(spec.shape[0], size, drop_remainder)
    order = permutation(cells.sparkSession, spec.shape[0], seed).where(F.col("pos") < n * size)
    return cells.join(order, "d0").select(G.floor_div("pos", size).alias("batch"), F.pmod("pos", F.lit(size)).cast("long").alias("at"), F.col("d0").alias("sample"), *spec.coords[1:], "value")


def paired(x: DataFrame, xs: ArraySpec, y: DataFrame, ys: ArraySpec, size: int, drop_remainder: bool = False) -> DataFrame:
    """Features with the label of the same sample: batch, d0 (position), d1.., value, label. Sample counts must agree; y has one value a sample."""
    if xs.shape[0] != ys.shape[0]:
        raise ArrayError("sample_count_mismatch", f"{xs.shape[0]} and {ys.shape[0]}")
    n = count_batches(xs.shape[0], size, drop_remainder)
    both = x.join(y.select("d0", F.col("value").alias("label")), "d0").where(F.col("d0") < n * size)
    return both.select(G.floor_div("d0", size).alias("batch"), F.pmod("d0", F.lit(size)).cast("long").alias("d0"), *xs.coords[1:], "value", "label")


def paired_shuffled(x: DataFrame, xs: ArraySpec, y: DataFrame, ys: ArraySpec, size: int, seed: int, drop_remainder: bool = False) -> DataFrame:
    if xs.shape[0] != ys.shape[0]:
        raise ArrayError("sample_count_mismatch", f"{xs.shape[0]} and {ys.shape[0]}")
    return shuffled(x, xs, size, seed, drop_remainder).join(y.select(F.col("d0").alias("sample"), F.col("value").alias("label")), "sample")


def tiles(cells: DataFrame, spec: ArraySpec, tile: Sequence[int]) -> DataFrame:
    """Tiles of any size, apart from chunks: t0.. and coordinates inside the tile; edge tiles are smaller."""
    if len(tile) != spec.ndim or any(t <= 0 for t in tile):
        raise ArrayError("invalid_tile", str(tile))
    return cells.select(*[G.floor_div(d, t).alias(f"t{i}") for i, (d, t) in enumerate(zip(spec.coords, tile, strict=True))], *[F.pmod(d, F.lit(t)).cast("long").alias(d) for d, t in zip(spec.coords, tile, strict=True)], "value")


def tensors(batched: DataFrame, spec: ArraySpec) -> DataFrame:
    """One row per batch: its values in row-major order."""
    key = F.struct(*spec.coords)
    return batched.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), "value")))["value"].alias("data"))
