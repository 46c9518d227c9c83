"""Incremental forms (an extension: the reference has no streams).

Conversations arrive as files or messages; each micro-batch runs the batch plans and is
upserted.  Raw messages are cut into sessions by event time, late ones up to a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur import schema


def history_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema.HISTORY).option("maxFilesPerTrigger", files_per_trigger).json(path)


def extract_stream(histories: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``handle`` (such as Engine.extract) on each micro-batch; upserts by deterministic ids make a repeated batch harmless."""
    return histories.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(messages: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n_messages) of messages (user_id, ts, ...), batch or stream alike."""
    if messages.isStreaming:
        messages = messages.withWatermark("ts", late)
    out = messages.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_messages"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_messages")


def activity(messages: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) in tumbling windows."""
    if messages.isStreaming:
        messages = messages.withWatermark("ts", late)
    out = messages.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_seen(messages: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen within the watermark: what a source delivers twice is taken once."""
    if messages.isStreaming:
        return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return messages.dropDuplicates([key])
