"""Running a streaming query to the end of what is there, with totals over all its micro-batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


@dataclass(frozen=True)
class Totals:
    """``late`` counts what came after the watermark had passed it: rows, or in an aggregation parts of a
    (window, group) as combined before the shuffle."""

    rows: int
    late: int
    batches: int


def drain(query: StreamingQuery, every: float = 0.5) -> Totals:
    """Wait for the end of ``query`` and add up its progress.

    A query keeps its last hundred reports only, so they are gathered while it runs, by batch.
    """
    seen: dict[tuple[str, int], tuple[int, int]] = {}

    def gather():
        for report in query.recentProgress:
            late = sum(op["numRowsDroppedByWatermark"] for op in report["stateOperators"])
            key = (str(report["runId"]), report["batchId"])
            old = seen.get(key, (0, 0))
            seen[key] = (max(old[0], report["numInputRows"]), max(old[1], late))

    while not query.awaitTermination(every):
        gather()
    gather()
    return Totals(sum(r for r, _ in seen.values()), sum(n for _, n in seen.values()), len(seen))


def append_available(stream: DataFrame, path: str, checkpoint: str) -> Totals:
    """Append what ``stream`` gives for the input present now to Parquet files at ``path``.

    State and progress are kept at ``checkpoint``: run again, it goes on where it ended, and a run that
    was broken off leaves neither gaps nor doubles.
    """
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    return drain(query)
