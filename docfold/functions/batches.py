"""Bounds of the batches that Arrow helpers get."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Every operator asks for the same bounds, so plans that run later aren't changed by other operators.
BATCH_ROWS, BATCH_BYTES = 128, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded rows and bytes, so long texts can't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
