"""Results that keep arriving: a file stream of records into the same summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.evaluation import group_summary
from ..sources.records import parsed_lines


def result_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Result rows from new files of a folder; malformed lines are left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return parsed_lines(lines, schemas.RESULT).withColumn("mode", F.coalesce("mode", F.lit("baseline")))


def live_summary(results: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """The group summary of all rows so far, as a table in memory; state is one row per mode and size."""
    return group_summary(results).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch(results: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands each micro-batch to an idempotent sink once more after a failure, under the same batch id."""
    return results.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by hour and type under a watermark; hours are closed once no late rows can come."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")
