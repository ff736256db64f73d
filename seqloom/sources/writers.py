"""Sinks. Each writes a folder that Spark readers take back; none collects rows on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import errors, metrics
from seqloom.session import checkpointed
from seqloom.sources.storage import write_bytes


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One JSON document per line and subject."""
    manifest.write.option("ignoreNullFields", False).json(path)


def write_audit(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines per audit table; per-subject detail is not part of a report."""
    for name, table in tables.items():
        table.write.json(f"{path}/{name}")


def write_features(frames: DataFrame, path: str, partition: Sequence[str] = ("corpus", "modality")) -> None:
    frames.write.partitionBy(*partition).parquet(path)


def write_stats(stats: DataFrame, path: str) -> None:
    stats.write.parquet(path)


def write_labels(labels: DataFrame, path: str, sep: str = ",") -> None:
    labels.write.option("header", True).option("sep", sep).csv(path)


def write_predictions(subjects: DataFrame, path: str, bins: int = 10) -> None:
    """Subject predictions, metrics record, confusion matrix and calibration bins."""
    subjects = checkpointed(subjects)
    subjects.write.option("header", True).csv(f"{path}/subject_predictions")
    metrics.classification_metrics(subjects, bins=bins).write.json(f"{path}/metrics")
    metrics.confusion_long(subjects).write.option("header", True).csv(f"{path}/confusion_matrix")
    metrics.calibration_bins(subjects, bins).write.json(f"{path}/calibration")


# Keys of the review document.
REVIEW_LISTS = ("top_false_positives", "top_false_negatives", "sparse_failures")
_REVIEW_ROW = "struct<subject_id: string, label: int, prediction: int, probability: double, num_windows: long>"


def write_error_review(subjects: DataFrame, path: str) -> None:
    """One document with the error counts and the three review lists, each in its order.

    The lists have a fixed length, so the document is small for any number of subjects.
    """
    subjects = checkpointed(subjects)
    picks = (errors.top_false_positives, errors.top_false_negatives, errors.sparse_failures)
    orders = (-F.col("probability"), F.col("probability"), -F.col("probability"))
    document = errors.error_counts(subjects)
    for name, pick, order in zip(REVIEW_LISTS, picks, orders):
        row = F.struct(order.alias("_at"), *errors.COLUMNS)
        rows = pick(subjects).agg(F.array_sort(F.collect_list(row)).alias(name))
        # the sort key goes, ties were put in order by subject
        plain = F.transform(name, lambda r: F.struct(*[r[c].alias(c) for c in errors.COLUMNS]))
        document = document.withColumn("_one", F.lit(1)).join(
            rows.select(plain.alias(name), F.lit(1).alias("_one")), "_one"
        ).drop("_one")
    document.coalesce(1).write.json(path)


def read_error_review(spark: SparkSession, path: str) -> DataFrame:
    lists = ", ".join(f"{name} array<{_REVIEW_ROW}>" for name in REVIEW_LISTS)
    counts = "false_positives long, false_negatives long, sparse_subjects long"
    return spark.read.schema(f"{counts}, {lists}").json(path)


def write_leaderboard(rows: DataFrame, path: str) -> None:
    """Sorted CSV; the order of the rows is kept by a single output file.

    A leaderboard has one row per experiment, so one file is enough at any data size.
    """
    rows.coalesce(1).write.option("header", True).csv(path)


def write_lines(lines: DataFrame, order: Sequence[str], path: str) -> None:
    """Text of a small report in the given order."""
    lines.orderBy(*order).select("line").coalesce(1).write.text(path)


def write_documents(documents: DataFrame, root: str, name: str) -> int:
    """One file ``<root>/<folder>/<name>`` per row of ``folder, document``; returns their number."""

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                write_bytes(f"{root}/{row.folder}/{name}", row.document.encode("utf-8"))
            yield batch[["folder"]]

    return documents.select("folder", "document").mapInPandas(save, "folder string").count()


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def pending(todo: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Items that the completed table lacks."""
    return todo.join(done.select(*key).distinct(), list(key), "left_anti")


def run_incremental(
    todo: DataFrame, path: str, key: Sequence[str], work: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Process what ``path`` does not hold yet, append it, and return the whole table.

    Running it again with the same items appends nothing.
    """
    spark = todo.sparkSession
    rest = pending(todo, spark.read.parquet(path), key) if table_exists(spark, path) else todo
    work(rest).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def report_lines(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Markdown table rows: ``position, line``."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    body = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return rows.select(F.col("position"), body.alias("line"))
