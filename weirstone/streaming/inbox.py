"""Structured Streaming: inbox files merged as they arrive, late repeats dropped, windows of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weirstone.functions.fields import url_key
from weirstone.operators.merge import merge


def inbox_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def unique_addresses(stream: DataFrame, arrived: str = "arrived_at", delay: str = "7 days") -> DataFrame:
    """Each address once; state older than the watermark is given up. Rows without address all stay."""
    s = stream.withWatermark(arrived, delay).withColumn("_u", F.coalesce(F.nullif(url_key(F.col("url")), F.lit("")), F.concat(F.lit("#"), F.col("seq").cast("string"))))
    return s.dropDuplicatesWithinWatermark(["_u"]).drop("_u")


def merge_stream(stream: DataFrame, history: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every micro-batch merged into what ``history`` gives then; ``sink`` gets the decisions and the batch number, to write idempotently."""

    def step(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(merge(history(), batch), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, ts: str, kind: str, size: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """(start, kind, n, total): windows of events, for streams with a watermark and for tables alike."""
    e = events.withWatermark(ts, delay) if events.isStreaming else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return e.groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")
