"""Arrays over ordinary tables: which columns are coordinates, which one is the value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import ArraySpec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vector, component)"""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("d0"), F.posexplode("embedding").alias("d1", "value")).select("d0", F.col("d1").cast("long").alias("d1"), F.col("value").cast("double").alias("value"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("d0"), F.col("o_totalprice").alias("value"))


def parts(spark: SparkSession, sf_dir: str, column: str = "p_retailprice") -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("d0"), F.col(column).cast("double").alias("value"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("d0"), "value")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades: time, symbol, price, and the number in props as size."""
    size = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("t"), F.col("user_id").alias("symbol"), F.col("value").alias("price"), size.alias("size"))


TYPES = ["click", "error", "purchase", "signup", "view"]


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day of month - 1, user, event type): summed value; sparse."""
    kind = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("event_type")) - 1
    return table(spark, sf_dir, "events").groupBy((F.dayofmonth("ts") - 1).cast("long").alias("d0"), F.col("user_id").alias("d1"), kind.alias("d2")).agg(F.sum("value").alias("value"))


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, line - 1): summed quantity, as the pair isn't unique."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("d0"), (F.col("l_linenumber") - 1).cast("long").alias("d1")).agg(F.sum("l_quantity").alias("value"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("d1")).distinct().withColumn("zone", F.pmod("d1", F.lit(5)))


def spec_of(cells: DataFrame, chunks: tuple[int, ...], **more) -> ArraySpec:
    """A specification whose shape covers the cells' coordinates; empty cells make an array of one element."""
    n = len(chunks)
    top = cells.agg(*[F.max(f"d{i}") for i in range(n)]).first()
    return ArraySpec(tuple(int(x if x is not None else 0) + 1 for x in top), chunks, **more)


def extent(spark: SparkSession, sf_dir: str, name: str, *ends: str) -> tuple[int, ...]:
    """Shape from expressions over the table itself, so that no cells are made to find it."""
    top = table(spark, sf_dir, name).selectExpr(*[f"max({e}) AS e{i}" for i, e in enumerate(ends)]).first()
    return tuple(int(x) if x is not None else 1 for x in top)
