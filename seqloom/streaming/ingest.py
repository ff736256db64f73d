"""Incremental ingestion: files that were not there at the last run are processed, others are not.

The streaming checkpoint remembers which files are done, which replaces looking at every output
before starting. ``availableNow`` makes a run end when all files present at its start are handled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqloom.streaming.run import append_available


def append_new_files(
    spark: SparkSession,
    landing: str,
    schema: str,
    out: str,
    checkpoint: str,
    work: Callable[[DataFrame], DataFrame],
    *,
    file_format: str = "parquet",
    options: dict[str, str] | None = None,
) -> int:
    """Run ``work`` on the files that arrived in ``landing`` and append the result to ``out``.

    ``work`` must be row-wise (parse, project, filter). A run that is interrupted is taken up again
    from the checkpoint without doubling rows. Returns the number of input rows of this run.
    """
    arrived = (
        spark.readStream.format(file_format).schema(schema).options(**(options or {})).load(landing)
    )
    return append_available(work(arrived), out, checkpoint).rows
