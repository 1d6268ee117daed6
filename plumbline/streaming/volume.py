"""OBS-1, OBS-2 on streams: daily volumes and freshness of each group, kept as event-time windows.

A day's row is written once, when the watermark, the newest event so far less ``delay``, has passed its
end; until then it is state, keyed by day and group, of which there is as much as there are days within
the delay. Events that come later than that are not added to days already written but counted, so that
batch and stream can be told to agree.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_volume(stream: DataFrame, time: str, by: Sequence[str] = (), delay: str = "1 day") -> DataFrame:
    """(day, *by, rows, first_at, newest) of a stream, or of a table; a null group is a group.

    Events without a time belong to no day.
    """
    at = F.col(time).cast("timestamp")
    events = stream.select(at.alias("_at"), *by).where(F.col("_at").isNotNull()).withWatermark("_at", delay)
    days = events.groupBy(F.window("_at", "1 day").alias("_day"), *by).agg(
        F.count(F.lit(1)).alias("rows"), F.min("_at").alias("first_at"), F.max("_at").alias("newest")
    )
    return days.select(F.col("_day.start").cast("date").alias("day"), *by, "rows", "first_at", "newest")


@dataclass
class Written:
    """What a run did: groups of late events left out (each one counted after it was added up in its
    batch), and the watermark that the days written lie below."""

    late: int
    watermark: str | None


def write_daily_volume(
    stream: DataFrame, time: str, path: str, checkpoint: str, by: Sequence[str] = (), delay: str = "1 day"
) -> Written:
    """All that has arrived, appended to a parquet folder, exactly once over restarts."""
    query: StreamingQuery = (
        daily_volume(stream, time, by, delay)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    steps = query.recentProgress
    late = sum(s.numRowsDroppedByWatermark for p in steps for s in p.stateOperators)
    marks = [p.eventTime["watermark"] for p in steps if "watermark" in p.eventTime]
    return Written(late, max(marks, default=None))
