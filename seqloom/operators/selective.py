"""Selective prediction: what is gained by abstaining on subjects of low confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.skew import ordered_prefix


def risk_coverage(subjects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``threshold, subjects, covered, coverage, risk`` by falling confidence.

    Confidence is the probability of the predicted side. All subjects of one confidence enter
    together, so a row says what is covered, and which share of that is wrong, when every subject
    of at least ``threshold`` is decided. Subjects without a probability are never decided and do
    not count. Groups of any size are ranked in blocks.
    """
    confidence = F.greatest(F.col("probability"), F.lit(1.0) - F.col("probability"))
    points = (
        subjects.where(F.col("probability").isNotNull())
        .groupBy(*by, confidence.alias("threshold"))
        .agg(
            F.count(F.lit(1)).alias("subjects"),
            F.sum((F.col("prediction") != F.col("label")).cast("long")).alias("wrong"),
        )
    )
    ranked = ordered_prefix(points, by, -F.col("threshold"), ["subjects", "wrong"])
    covered = F.col("before_subjects") + F.col("subjects")
    return ranked.select(
        *by,
        "threshold",
        "subjects",
        covered.alias("covered"),
        (covered / F.col("total_subjects")).alias("coverage"),
        ((F.col("before_wrong") + F.col("wrong")) / covered).alias("risk"),
    )


def selective_summary(
    subjects: DataFrame, by: Sequence[str] = (), targets: Sequence[float] = (0.05, 0.1, 0.2)
) -> DataFrame:
    """Area under the risk-coverage curve and, for each target risk, the smallest threshold that meets it.

    One row per group and target: ``subjects, full_risk, aurc, target, threshold, coverage``. The
    area is the mean risk over subjects as they are taken in. Where no threshold meets a target
    both are NULL.
    """
    within = {t: F.col("risk") <= F.lit(float(t)) for t in targets}
    found = risk_coverage(subjects, by).groupBy(*by).agg(
        F.sum("subjects").alias("subjects"),
        F.max_by("risk", "covered").alias("full_risk"),
        (F.sum(F.col("risk") * F.col("subjects")) / F.sum("subjects")).alias("aurc"),
        *[F.min(F.when(ok, F.col("threshold"))).alias(f"_t{i}") for i, ok in enumerate(within.values())],
        *[F.max(F.when(ok, F.col("coverage"))).alias(f"_c{i}") for i, ok in enumerate(within.values())],
    )
    rows = F.array(
        *[
            F.struct(F.lit(float(t)).alias("target"), F.col(f"_t{i}").alias("threshold"), F.col(f"_c{i}").alias("coverage"))
            for i, t in enumerate(targets)
        ]
    )
    return found.select(*by, "subjects", "full_risk", "aurc", F.explode(rows).alias("_r")).select(
        *by, "subjects", "full_risk", "aurc", "_r.*"
    )
