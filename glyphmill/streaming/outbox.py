"""The outbox as a stream: at-least-once delivery with de-duplication, and keyed state for leases and versions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def deduplicated(events: DataFrame, time: str = "created_at", delay: str = "10 minutes") -> DataFrame:
    """Events once for each job id within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(["job_id"])


def relay(events: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Publishes each micro-batch; ``publish`` gets the batch's number and must be idempotent in it, since a batch may come again."""
    writer = events.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def monotone_versions(versions: DataFrame) -> DataFrame:
    """Promotions over a stream of document_id and version_no: a version becomes current only if it is the greatest so far."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else None
        for pdf in frames:
            out = []
            for v in pdf.sort_values("version_no")["version_no"]:
                promoted = top is None or v > top
                top = v if promoted else top
                out.append((key[0], int(v), bool(promoted), int(top)))
            yield pd.DataFrame(out, columns=["document_id", "version_no", "promoted", "current_version"])
        state.update((int(top),))

    return versions.groupBy("document_id").applyInPandasWithState(step, "document_id string, version_no long, promoted boolean, current_version long", "top long", "append", "NoTimeout")


def windowed_counts(events: DataFrame, size: str = "10 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Extension: events and values by event-time window and type, with a watermark for late rows."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    made = (events.withWatermark("ts", delay) if events.isStreaming else events).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Extension: runs of a user's events with no gap longer than ``gap``."""
    made = (events.withWatermark("ts", delay) if events.isStreaming else events).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return made.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
