"""One row per subject, two corpora with different columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import flags
from seqloom.functions import labels as L
from seqloom.operators.audit import video_presence


def manifest_d(
    labels: DataFrame, shapes: DataFrame, links: DataFrame, downloaded: DataFrame
) -> DataFrame:
    """Subjects with a label and both modalities.

    ``labels``: subject_id, label, duration, gender, fold. ``shapes``: one row per subject with
    lengths, widths and paths by modality. ``links``: video_id, key. ``downloaded``: key.
    """
    both = shapes.where(F.col("acoustic_len").isNotNull() & F.col("visual_len").isNotNull())
    videos = video_presence(links, downloaded).select(
        F.col("video_id").alias("subject_id"), F.col("key").alias("video_key"), "has_raw_video"
    )
    joined = both.join(labels, "subject_id").join(videos, "subject_id", "left")
    return joined.select(
        F.col("subject_id").cast("string").alias("subject_id"),
        F.lit("dvlog").alias("dataset_source"),
        L.label_binary(F.col("label")).alias("label_binary"),
        F.lit(None).cast("int").alias("label_phq"),
        "fold",
        "gender",
        F.col("duration").alias("duration_seconds"),
        "acoustic_path",
        "visual_path",
        "acoustic_len",
        "visual_len",
        F.least("acoustic_len", "visual_len").alias("aligned_len"),
        "acoustic_dim",
        "visual_dim",
        F.coalesce("has_raw_video", F.lit(False)).alias("has_raw_video"),
        "video_key",
        flags.flags_d(F.col("acoustic_len"), F.col("visual_len")).alias("quality_flags"),
    )


def manifest_e(
    labels: DataFrame,
    shapes: DataFrame,
    metadata: DataFrame,
    issues: DataFrame,
    archives: DataFrame,
    ai_from: int = L.AI_SESSION_FROM,
) -> DataFrame:
    """Every labelled subject; what is missing shows up as flags.

    ``labels``: participant, label_binary, phq, fold, gender, age. ``shapes`` as for corpus D with
    paths of arrays and timestamps. ``metadata``: subject_id, status, warnings. ``issues``:
    subject_id, warnings of subjects reported as partial or failed. ``archives``: participant,
    archive_path.
    """
    base = labels.withColumn("subject_id", F.concat(F.col("participant").cast("string"), F.lit("_P")))
    reported = issues.select(
        "subject_id", F.lit(True).alias("_issue"), F.concat_ws("; ", "warnings").alias("_error")
    )
    joined = (
        base.join(shapes, "subject_id", "left")
        .join(metadata.select("subject_id", "status", "warnings"), "subject_id", "left")
        .join(reported, "subject_id", "left")
        .join(archives.select("participant", "archive_path"), "participant", "left")
    )
    status = F.coalesce(F.col("status"), F.lit("not_extracted"))
    has_issue = F.coalesce(F.col("_issue"), F.lit(False))
    return joined.select(
        "subject_id",
        F.lit("edaic").alias("dataset_source"),
        "label_binary",
        F.col("phq").alias("label_phq"),
        "fold",
        "gender",
        "age",
        L.session_type(F.col("participant"), ai_from).alias("session_type"),
        "archive_path",
        "acoustic_path",
        "acoustic_timestamps_path",
        "visual_path",
        "visual_timestamps_path",
        "acoustic_len",
        "visual_len",
        L.aligned_length(F.col("visual_len"), F.col("acoustic_len")).alias("aligned_len"),
        "acoustic_dim",
        "visual_dim",
        flags.flags_e(
            F.col("acoustic_len"), F.col("visual_len"), status, F.col("warnings"), has_issue
        ).alias("quality_flags"),
        (status == "success").alias("extracted"),
        status.alias("extraction_status"),
        F.col("_error").alias("extraction_error"),
    )


def union_manifests(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both corpora; columns one side lacks are NULL there."""
    return first.unionByName(second, allowMissingColumns=True)
