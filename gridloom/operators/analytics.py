"""Analyses over array cells: partial and final aggregates, no collected groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..spec import ArraySpec


def ohlc(ticks: DataFrame, key: str = "symbol", time: str = "t", price: str = "price", size: str = "size") -> DataFrame:
    """First, highest, lowest and last price of each key by time, and the price weighted by size (total size at least 1e-9)."""
    weight = F.sum(F.col(price) * F.col(size)) / F.greatest(F.sum(size), F.lit(1e-9))
    return ticks.groupBy(key).agg(F.min_by(price, time).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, time).alias("close"), weight.alias("vwap"), F.count(F.lit(1)).alias("n"))


def ohlc_by_chunk(ticks: DataFrame, width: int, key: str = "symbol", time: str = "t", price: str = "price", size: str = "size") -> DataFrame:
    """The same from one partial result per (chunk of time, key): merging is associative."""
    part = ticks.groupBy(G.floor_div(time, width).alias("chunk"), key).agg(
        F.min(time).alias("t0"), F.max(time).alias("t1"), F.min_by(price, time).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, time).alias("close"), F.sum(F.col(price) * F.col(size)).alias("ps"), F.sum(size).alias("s"), F.count(F.lit(1)).alias("n")
    )
    return part.groupBy(key).agg(F.min_by("open", "t0").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "t1").alias("close"), (F.sum("ps") / F.greatest(F.sum("s"), F.lit(1e-9))).alias("vwap"), F.sum("n").alias("n"))


def mean_over(cells: DataFrame, spec: ArraySpec, axis: int, densify: bool = True) -> DataFrame:
    """Mean along an axis. Over a dense array absent cells count as fill, which is added without making them."""
    rest = [d for i, d in enumerate(spec.coords) if i != axis]
    total, n = F.sum(F.col("value").cast("double")), F.count(F.lit(1))
    size = spec.shape[axis]
    mean = (total + (size - n) * float(spec.fill)) / size if densify else total / n
    return cells.groupBy(*rest).agg(mean.alias("mean"))


def overall(cells: DataFrame, spec: ArraySpec) -> DataFrame:
    """Mean, sum, least and greatest of the whole dense array, fill included analytically."""
    fill, n = float(spec.fill), F.count(F.lit(1))
    absent = F.lit(spec.size) - n
    return cells.agg(
        (F.coalesce(F.sum(F.col("value").cast("double")), F.lit(0.0)) + absent * fill).alias("sum"),
        ((F.coalesce(F.sum(F.col("value").cast("double")), F.lit(0.0)) + absent * fill) / spec.size).alias("mean"),
        F.when(absent > 0, F.least(F.min("value"), F.lit(fill))).otherwise(F.min("value")).alias("least"),
        F.when(absent > 0, F.greatest(F.max("value"), F.lit(fill))).otherwise(F.max("value")).alias("greatest"),
        F.count(F.lit(1)).alias("stored"),
    )


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), 0 where the sum is 0."""
    return F.when(a + b == 0, F.lit(0.0)).otherwise((a - b) / F.when(a + b == 0, F.lit(1.0)).otherwise(a + b))


def band_difference(cells: DataFrame, band_axis: str, first: int, second: int, by: list[str]) -> DataFrame:
    """Normalised difference of two bands at each place, by one conditional aggregate."""
    pick = lambda k: F.coalesce(F.max(F.when(F.col(band_axis) == k, F.col("value"))), F.lit(0.0))
    got = cells.where(F.col(band_axis).isin(first, second)).groupBy(*by).agg(pick(first).alias("a"), pick(second).alias("b"))
    return got.select(*by, normalised_difference(F.col("a"), F.col("b")).alias("index"))


def zonal_mean(cells: DataFrame, zones: DataFrame, on: list[str]) -> DataFrame:
    """Mean and number of cells of each zone; the join's strategy is left to the sizes."""
    return cells.join(zones, on).groupBy("zone").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("pixels"))


def describe(cells: DataFrame, *by: str) -> DataFrame:
    """Mean, least, greatest and population deviation."""
    return cells.groupBy(*by).agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.stddev_pop("value").alias("deviation"), F.count(F.lit(1)).alias("n"))


def chunk_stats(cells: DataFrame, spec: ArraySpec) -> DataFrame:
    return describe(G.with_chunks(cells, spec), *spec.chunk_coords)


def arg_extremes(cells: DataFrame, at: str) -> DataFrame:
    return cells.agg(F.min_by(at, F.struct("value", at)).alias("argmin"), F.max_by(at, F.struct("value", -F.col(at))).alias("argmax"), F.min("value").alias("least"), F.max("value").alias("greatest"))


def correlation(a: DataFrame, b: DataFrame, on: list[str], *by: str) -> DataFrame:
    """Pearson correlation of two arrays over common coordinates, for each of ``by``; not a number where either is constant, null without a pair of values.

    F.corr divides by zero there, which is an error in ANSI mode, also for groups that a later filter drops.
    """
    both = a.withColumnRenamed("value", "x").join(b.withColumnRenamed("value", "y"), on)
    x, y = (F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.col(c)) for c in ("x", "y"))
    got = both.groupBy(*by).agg(F.covar_pop("x", "y").alias("_c"), (F.stddev_pop(x) * F.stddev_pop(y)).alias("_s"), F.count(F.lit(1)).alias("n"))
    r = F.when(F.col("_s") == 0, F.lit(float("nan"))).otherwise(F.try_divide("_c", "_s"))
    return got.select(*by, r.alias("r"), "n")


def zscore(cells: DataFrame, *by: str) -> DataFrame:
    """(value - mean) / population deviation; 0 where the deviation is 0. The statistics are one row per group."""
    stats = cells.groupBy(*by).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    joined = cells.join(stats, list(by)) if by else cells.crossJoin(F.broadcast(stats))  # one row
    return joined.withColumn("value", F.when(F.col("_s") == 0, F.lit(0.0)).otherwise((F.col("value") - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def matvec(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """cells (d0, d1, value) times weights (d1, w): (d0, y)."""
    return cells.join(weights, "d1").groupBy("d0").agg(F.sum(F.col("value") * F.col("w")).alias("y"))


def mse(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """Mean squared error of (d0, y) against (d0, value)."""
    return predicted.join(actual, "d0").agg(F.avg(F.pow(F.col("y") - F.col("value"), F.lit(2.0))).alias("mse"), F.count(F.lit(1)).alias("n"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, v: t + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors, 0 where one has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(norms == 0, F.lit(1.0)).otherwise(norms))


def cosine_top(vectors: DataFrame, query: DataFrame, k: int, id_col: str, vector: str) -> DataFrame:
    """The k vectors nearest to the one row of ``query`` (column q), ties by id."""
    return vectors.crossJoin(F.broadcast(query.limit(1))).select(id_col, cosine(F.col(vector), F.col("q")).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def hash_embedding(docs: DataFrame, dim: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bucket, value): words of the lower-cased text without other signs, each adding a sign to a hashed bucket."""
    clean = F.regexp_replace(F.lower(F.coalesce(text_col, F.lit(""))), r"[^a-z0-9\s]", "")
    words = docs.select(id_col, F.explode(F.filter(F.split(clean, r"\s+"), lambda w: w != "")).alias("w"))
    h = F.xxhash64("w")
    return words.groupBy(id_col, F.pmod(h, F.lit(dim)).alias("bucket")).agg(F.sum(F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias("value"))
