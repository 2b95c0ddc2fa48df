"""Running evaluation over arriving scans: a stateful confusion count by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def point_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 20) -> DataFrame:
    """Points from Parquet files that arrive in a folder, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def running_confusion(points: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """Counts of (truth, pred) so far; the state is as small as the matrix."""
    return points.groupBy(truth.alias("truth"), predicted.alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def start(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Into an in-memory table of all counts, processing what is there and stopping."""
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
