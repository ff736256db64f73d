"""Sliding event-time windows over a stream of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_windows(
    events: DataFrame,
    by: Sequence[str],
    value: str,
    *,
    ts: str = "ts",
    size: str = "1 day",
    slide: str = "6 hours",
    delay: str = "1 hour",
) -> DataFrame:
    """``start, end, by, events, mean, low, high`` of every closed window.

    A window is given out once, when the watermark (latest event time less ``delay``) has passed its
    end; its state is then given up, and events that still come for it are late and dropped. Events
    without a time belong to no window. On a static table the result has every window, closed or not.
    """
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, size, slide), *by)
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.avg(value).alias("mean"),
            F.min(value).alias("low"),
            F.max(value).alias("high"),
        )
        .select("window.start", "window.end", *by, "events", "mean", "low", "high")
    )
