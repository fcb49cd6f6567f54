"""Arrays that grow from a stream: appended samples and region overwrites, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.mutate import overlay
from ..spec import ArraySpec


def cell_stream(spark: SparkSession, path: str, spec: ArraySpec, max_files: int = 100) -> DataFrame:
    """Cells of Parquet files as they land in a folder."""
    return spark.readStream.schema(spec.schema).option("maxFilesPerTrigger", max_files).parquet(path)


def append_to(cells: DataFrame, spec: ArraySpec, table: str, checkpoint: str):
    """Appends streamed cells to a chunk-partitioned table; the sink's log makes each batch count once."""
    keyed = cells.withColumn("c0", G.chunk_index(spec, 0))
    return keyed.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).partitionBy("c0").outputMode("append")


def overlay_batches(spec: ArraySpec, read: Callable[[], DataFrame], write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the latest value (by ``seq``; without it the largest) of each coordinate in the batch replaces the stored one.

    A replayed batch gives the same state again, so nothing depends on the epoch as long
    as ``write`` replaces the state and batches come in order.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        last = batch.groupBy(*spec.coords).agg(F.max_by("value", "seq").alias("value")) if "seq" in batch.columns else batch.groupBy(*spec.coords).agg(F.max("value").alias("value"))
        write(overlay(read(), last, spec))

    return apply


def windowed_stats(events: DataFrame, time: str, value: str, width: str, late: str, *by: str) -> DataFrame:
    """Count, mean and extremes of event-time windows; for output modes append and update: there events later than ``late`` are dropped and closed windows leave the state."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"))
