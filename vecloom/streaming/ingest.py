"""Structured Streaming into an op log, and the newest versions of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vecloom.operators import oplog


def ops(spark: SparkSession, path: str, schema, files_per_batch: int = 2) -> DataFrame:
    """A stream of files of operations."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append(stream: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a stream of log rows to Parquet, exactly once by the sink's own log. Sequences order the rows, whenever they arrive."""
    writer = stream.select(*oplog.FIELDS).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The newest version of each node of what has been committed."""
    return oplog.latest(spark.read.schema(oplog.SCHEMA).parquet(target))


def live_counts(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """A running count of operations and the last sequence by node, kept in the state store."""
    from pyspark.sql import functions as F

    counted = stream.groupBy("node_id").agg(F.count(F.lit(1)).alias("writes"), F.max_by("deleted", "seq").alias("deleted"), F.max("seq").alias("seq"))
    return counted.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
