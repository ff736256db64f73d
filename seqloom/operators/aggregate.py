"""Window probabilities to subject probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.skew import ONE_TASK_ROWS, ordered_prefix

METHODS = ("mean", "topk", "attention")
# Sums of doubles depend on the order in which partitions are added. Rounded here, subjects with
# equal windows get equal probabilities, so thresholds and ties do not depend on partitioning.
PROBABILITY_DIGITS = 12


def _check_methods(methods: Sequence[str]) -> list[str]:
    unknown = [m for m in methods if m not in METHODS]
    if unknown:
        raise ValueError(f"Subjects cannot be scored by {', '.join(unknown)}")
    return list(methods)


def mean_probability(p: Column) -> Column:
    return F.avg(p)


def attention_probability(p: Column) -> Column:
    """Mean weighted by the softmax of the probabilities themselves."""
    return F.sum(p * F.exp(p)) / F.sum(F.exp(p))


def top_share_count(n: Column, fraction: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(n * F.lit(fraction))).cast("long")


def subject_scores(
    windows: DataFrame,
    methods: Sequence[str] = METHODS,
    *,
    subject: str = "subject_id",
    label: str = "label",
    probability: str = "window_probability",
    by: Sequence[str] = (),
    topk_fraction: float = 0.25,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """All requested subject probabilities, one column per method; the input is read once.

    ``mean`` and ``attention`` are sums, combined before the shuffle. ``topk`` needs an order: windows
    are first counted by (subject, probability), which is combined before the shuffle too and
    spreads a large subject over tasks. Those counts are stored, and running counts over them give
    each probability its share of the top; all other columns come from the same counts.
    """
    methods = _check_methods(methods)
    keys = [*by, subject]
    p = F.col(probability)
    if "topk" not in methods:
        sums = {"mean": mean_probability(p), "attention": attention_probability(p)}
        common = [F.min(label).alias("label"), F.count(F.lit(1)).alias("num_windows")]
        return _stable(windows.groupBy(*keys).agg(*common, *[sums[m].alias(m) for m in methods]), methods)

    counts = windows.groupBy(*keys, probability).agg(
        F.min(label).alias("_label"), F.count(F.lit(1)).alias("_n")
    )
    ranked = ordered_prefix(counts, keys, -p, ["_n"], one_task_rows=one_task_rows)
    n, known = F.col("_n"), F.when(p.isNotNull(), F.col("_n"))
    k = top_share_count(F.col("total__n"), topk_fraction)
    taken = F.greatest(F.lit(0), F.least(n, k - F.col("before__n")))
    scores = {
        "mean": F.sum(p * n) / F.sum(known),
        "attention": F.sum(p * F.exp(p) * n) / F.sum(F.exp(p) * n),
        "topk": F.sum(p * taken) / F.max(k),
    }
    grouped = ranked.groupBy(*keys).agg(
        F.min("_label").alias("label"),
        F.sum(n).alias("num_windows"),
        *[scores[m].alias(m) for m in methods],
    )
    return _stable(grouped, methods)


def _stable(scores: DataFrame, methods: Sequence[str]) -> DataFrame:
    return scores.withColumns({m: F.round(m, PROBABILITY_DIGITS) for m in methods})


def with_prediction(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scores.withColumn("prediction", (F.col("probability") >= threshold).cast("int"))


def to_subjects(
    windows: DataFrame,
    method: str,
    *,
    subject: str = "subject_id",
    by: Sequence[str] = (),
    topk_fraction: float = 0.25,
    threshold: float = 0.5,
    **options,
) -> DataFrame:
    """``subject_id, label, num_windows, probability, prediction`` for one method."""
    scores = subject_scores(
        windows, [method], subject=subject, by=by, topk_fraction=topk_fraction, **options
    )
    return with_prediction(scores.withColumnRenamed(method, "probability"), threshold).select(
        *by, subject, "label", "num_windows", "probability", "prediction"
    )


def to_subjects_all(
    windows: DataFrame,
    methods: Sequence[str] = METHODS,
    *,
    subject: str = "subject_id",
    by: Sequence[str] = (),
    threshold: float = 0.5,
    **options,
) -> DataFrame:
    """As :func:`to_subjects` for several methods at once, with a ``method`` column."""
    scores = subject_scores(windows, methods, subject=subject, by=by, **options)
    long = scores.select(
        *by,
        subject,
        "label",
        "num_windows",
        F.explode(
            F.array(
                *[F.struct(F.lit(m).alias("method"), F.col(m).alias("p")) for m in methods]
            )
        ).alias("_s"),
    ).select(
        *by,
        F.col("_s.method").alias("method"),
        subject,
        "label",
        "num_windows",
        F.col("_s.p").alias("probability"),
    )
    return with_prediction(long, threshold)
