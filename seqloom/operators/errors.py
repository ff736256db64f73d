"""Error review of subject predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("subject_id", "label", "prediction", "probability", "num_windows")
# How many subjects each review list shows, and what counts as few windows.
REVIEW_SIZE = 10
SPARSE_WINDOWS = 2


def _false_positive() -> Column:
    return (F.col("label") == 0) & (F.col("prediction") == 1)


def _false_negative() -> Column:
    return (F.col("label") == 1) & (F.col("prediction") == 0)



def error_counts(subjects: DataFrame, max_windows: int = SPARSE_WINDOWS) -> DataFrame:
    def total(condition):
        return F.coalesce(F.sum(condition.cast("long")), F.lit(0))

    return subjects.agg(
        total(_false_positive()).alias("false_positives"),
        total(_false_negative()).alias("false_negatives"),
        total(F.col("num_windows") <= max_windows).alias("sparse_subjects"),
    )


def _first(subjects: DataFrame, condition, order, n: int) -> DataFrame:
    return subjects.where(condition).select(*COLUMNS).orderBy(order, "subject_id").limit(n)


def top_false_positives(subjects: DataFrame, n: int = REVIEW_SIZE) -> DataFrame:
    return _first(subjects, _false_positive(), F.col("probability").desc(), n)


def top_false_negatives(subjects: DataFrame, n: int = REVIEW_SIZE) -> DataFrame:
    return _first(subjects, _false_negative(), F.col("probability").asc(), n)


def sparse_failures(
    subjects: DataFrame, n: int = REVIEW_SIZE, max_windows: int = SPARSE_WINDOWS
) -> DataFrame:
    wrong = F.col("prediction") != F.col("label")
    few = F.col("num_windows") <= max_windows
    return _first(subjects, wrong & few, F.col("probability").desc(), n)
