"""Micro-batch indexing of a landing folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def landing(spark: SparkSession, folder: str, schema: str = "path string, text string", per_batch: int = 1000) -> DataFrame:
    """Files of JSON lines (path, text) as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(folder)


def index(stream: DataFrame, build: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True):
    """Write what `build` makes of each micro-batch, in a folder of the batch's own, so a batch that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{out}/batch_id={number}")

    w = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def rates(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window, event_type, n) of an event stream (ts, event_type) with late rows up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
