"""Sizes of Arrow batches, by bytes of text rather than by rows."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch of texts; tasks hold a few of them on either side.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches to ``BATCH_BYTES``, so that a task's memory follows that and its longest text."""
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
