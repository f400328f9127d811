"""Retrieval logs as streams: windowed counts with late data, deduplication, upserts and running sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "2 hours", value: str | None = None) -> DataFrame:
    """start, by, n (and the sum of ``value``) for each window; works on batches and on streams, where rows later than
    ``late`` are dropped."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    measures = [F.count("*").alias("n")] + ([F.round(F.sum(value), 2).alias("total")] if value else [])
    return rows.groupBy(F.window(time, width).alias("w"), by).agg(*measures).select(F.col("w.start").alias("start"), by, *["n", "total"][: len(measures)])


def once(events: DataFrame, key: str, time: str, late: str = "2 hours") -> DataFrame:
    """Redelivered events once; on streams within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def append(events: DataFrame, path: str, checkpoint: str, once_only: bool = True):
    """Appends a stream to a log of JSON lines; with ``once_only`` it takes what is there and stops."""
    writer = events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once_only else writer).start()


def maintain(events: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str):
    """Keeps an index in step with a stream of changed rows: each micro-batch is handed to ``upsert``."""
    return events.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, user: str, time: str, gap_seconds: int = 1800) -> DataFrame:
    """user, start, end, n of runs of events that are at most ``gap_seconds`` apart.  For batches and, with a state for
    each user that a timeout closes, for streams."""
    if not events.isStreaming:
        width = f"{gap_seconds} seconds"
        grouped = events.groupBy(user, F.session_window(time, width).alias("w")).agg(F.count("*").alias("n"), F.max(time).alias("end"))
        return grouped.select(user, F.col("w.start").alias("start"), "end", "n")

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, end, n = state.get if state.exists else (None, None, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({user: [key[0]], "start": [pd.Timestamp(start, unit="us")], "end": [pd.Timestamp(end, unit="us")], "n": [n]})
            return
        closed = []
        for at in sorted(t for f in frames for t in f[time].astype("datetime64[us]").astype("int64")):
            if end is not None and at - end > gap_seconds * 1_000_000:
                closed.append((key[0], pd.Timestamp(start, unit="us"), pd.Timestamp(end, unit="us"), n))
                start, n = None, 0
            start, end, n = at if start is None else start, at if end is None or start is None else max(end, at), n + 1
        state.update((start, end, n))
        state.setTimeoutTimestamp(max(end // 1000 + gap_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(closed, columns=[user, "start", "end", "n"])

    kind = events.schema[user].dataType.simpleString()
    rows = events.select(user, time).withWatermark(time, f"{gap_seconds} seconds")
    return rows.groupBy(user).applyInPandasWithState(fold, f"{user} {kind}, start timestamp, end timestamp, n long", "start long, end long, n long", "append", "EventTimeTimeout")
