"""Landed responses as a stream: each run is a micro-batch through the same batch readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def ingest_available(spark: SparkSession, landed: str, schema: StructType | str, read: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files: int = 1000) -> DataFrame:
    """Reads what has landed since the last call, ``files`` files a batch, and returns the whole output table.

    A batch overwrites its own folder, so a batch that is run again after a failure
    leaves the same rows.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        read(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(landed)
    stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def first_arrivals(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first row of each key; a repeat within ``delay`` of event time is dropped, and state is kept no longer."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)
