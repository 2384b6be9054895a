"""Streams: error signatures per hour, redacted text, first sight of a signature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions.personal import redact_literals
from tamiz.operators.logs import describe_events

EVENTS = "file string, line_no bigint, kind string, stamp string, lines array<string>, ts timestamp"


def read_event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Assembled events, one JSON record each."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def stream_signatures(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Signature counts per tumbling window; events later than the watermark are dropped and show
    in the query's progress."""
    described = describe_events(events.withWatermark("ts", late))
    return described.groupBy(F.window("ts", window).alias("w"), "hash").agg(F.count("*").alias("count")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "hash", "count")


def stream_redact(texts: DataFrame, column: str = "text") -> DataFrame:
    return texts.withColumn(column, redact_literals(F.col(column)))


def first_sight(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first event of each signature within the watermark."""
    return describe_events(events.withWatermark("ts", late)).dropDuplicatesWithinWatermark(["hash"]).select(
        "ts", "hash", "exception", "origin")


def late_rows(progress: dict) -> int:
    """Events a finished batch dropped as too late."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for op in progress.get("stateOperators", []))


def start_upserts(stream: DataFrame, write_batch, checkpoint: str):
    """Run an aggregated stream in update mode into ``write_batch(df, epoch)`` until its input is read."""
    return (stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(write_batch).start())
