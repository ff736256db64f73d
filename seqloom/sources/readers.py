"""Label tables, links, reports and delimited feature files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import labels as L

# The columns of the visual feature files, in vector order.
POSE = ("pose_Tx", "pose_Ty", "pose_Tz", "pose_Rx", "pose_Ry", "pose_Rz")
GAZE = (
    "gaze_0_x", "gaze_0_y", "gaze_0_z",
    "gaze_1_x", "gaze_1_y", "gaze_1_z",
    "gaze_angle_x", "gaze_angle_y",
)
ACTION_UNITS_INTENSITY = (
    "AU01_r", "AU02_r", "AU04_r", "AU05_r", "AU06_r", "AU07_r", "AU09_r", "AU10_r", "AU12_r",
    "AU14_r", "AU15_r", "AU17_r", "AU20_r", "AU23_r", "AU25_r", "AU26_r", "AU45_r",
)
ACTION_UNITS_PRESENCE = (
    "AU01_c", "AU02_c", "AU04_c", "AU05_c", "AU06_c", "AU07_c", "AU09_c", "AU10_c", "AU12_c",
    "AU14_c", "AU15_c", "AU17_c", "AU20_c", "AU23_c", "AU25_c", "AU26_c", "AU28_c", "AU45_c",
)
VISUAL_FEATURES = (*POSE, *GAZE, *ACTION_UNITS_INTENSITY, *ACTION_UNITS_PRESENCE)
VISUAL_REQUIRED = ("timestamp", "confidence", "success", *VISUAL_FEATURES)
# Columns of the acoustic files that are not features; the time column.
ACOUSTIC_METADATA = ("name", "frameTime")
ACOUSTIC_TIME = "frameTime"

LABELS_D_SCHEMA = "index int, label string, duration double, gender string, fold string"
LINKS_SCHEMA = "video_id long, key string"
REPORT_SCHEMA = (
    "total_archives long, successful long, partial long, failed long, "
    "errors array<struct<participant: string, status: string, error: string, warnings: array<string>>>"
)
METADATA_SCHEMA = (
    "participant string, extractor_version string, status string, warnings array<string>, "
    "visual_available boolean, acoustic_available boolean, "
    "visual_shape array<long>, acoustic_shape array<long>, "
    "confidence_mean double, low_confidence_ratio double, success_ratio double"
)
_METRICS = "macro_f1 double, weighted_f1 double, auroc double, pr_auc double"
SUMMARY_SCHEMA = (
    "stage_name string, suite_track string, dataset string, modality string, "
    "candidate_name string, selected_aggregation string, "
    f"dev_metrics_mean struct<{_METRICS}>, dev_metrics_std struct<{_METRICS}>, "
    f"test_metrics_mean struct<{_METRICS}>, test_metrics_std struct<{_METRICS}>"
).replace(" double", ": double")


def read_labels_d(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, schema=LABELS_D_SCHEMA)
    return raw.select(
        F.col("index").cast("string").alias("subject_id"),
        L.label_binary(F.col("label")).alias("label_binary"),
        "label",
        "duration",
        "gender",
        "fold",
    )


def read_labels_e(spark: SparkSession, path: str) -> DataFrame:
    """Columns are read as text and converted with a tolerance for empty or unreadable fields."""
    raw = trimmed_header(spark.read.csv(path, header=True))
    items = [F.col(c) for c in L.phq_columns(raw)]
    return raw.select(
        F.col("Participant").cast("long").alias("participant"),
        L.tolerant_int(F.col("Depression_label")).alias("label_binary"),
        F.array(*[L.tolerant_int(c) for c in items]).alias("phq_items"),
        L.phq_total(items).alias("phq"),
        F.col("split").alias("fold"),
        "gender",
        L.age_or_unknown(F.col("age")).alias("age"),
    )


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=LINKS_SCHEMA)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Per-subject extraction metadata, one JSON document per file or per line."""
    return (
        spark.read.schema(METADATA_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("multiLine", True)
        .json(path)
    )


def read_report_errors(spark: SparkSession, path: str) -> DataFrame:
    """The error entries of extraction reports, one row each."""
    reports = spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(path)
    return reports.select(F.explode("errors").alias("_e")).select("_e.*")


def read_run_summaries(spark: SparkSession, root: str) -> DataFrame:
    """Every ``summary.json`` below ``root``, with its path."""
    return (
        spark.read.schema(SUMMARY_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "summary.json")
        .option("multiLine", True)
        .json(root)
        .withColumn("summary_path", F.col("_metadata.file_path"))
    )


# --- delimited features ---------------------------------------------------------------------------


def trimmed_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def missing_columns(present: Sequence[str], required: Sequence[str]) -> list[str]:
    return sorted(set(required) - {name.strip() for name in present})


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = missing_columns(df.columns, required)
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return df


def numeric_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns parsed as numbers; a row with any field that does not parse is dropped."""
    parsed = df.withColumns({c: L.tolerant_double(F.col(c)) for c in columns})
    return parsed.dropna(subset=list(columns))


def read_visual_csv(spark: SparkSession, path: str) -> DataFrame:
    """Visual feature files: ``path, ts, features, confidence, success``."""
    raw = require_columns(trimmed_header(spark.read.csv(path, header=True)), VISUAL_REQUIRED)
    rows = numeric_rows(raw.withColumn("path", F.col("_metadata.file_path")), VISUAL_REQUIRED)
    return rows.select(
        "path",
        F.col("timestamp").cast("float").alias("ts"),
        F.array(*VISUAL_FEATURES).cast("array<float>").alias("features"),
        F.col("confidence").cast("float").alias("confidence"),
        F.col("success").cast("int").alias("success"),
    )


def read_acoustic_csv(spark: SparkSession, path: str) -> DataFrame:
    """Acoustic feature files: every column that is not metadata is a feature."""
    raw = require_columns(
        trimmed_header(spark.read.csv(path, header=True, sep=";")), [ACOUSTIC_TIME]
    )
    features = [c for c in raw.columns if c not in ACOUSTIC_METADATA]
    rows = numeric_rows(
        raw.withColumn("path", F.col("_metadata.file_path")), [*features, ACOUSTIC_TIME]
    )
    return rows.select(
        "path",
        F.col(ACOUSTIC_TIME).cast("float").alias("ts"),
        F.array(*features).cast("array<float>").alias("features"),
    )


def split_fields(line: Column, sep: str) -> Column:
    """Fields of one line; a separator inside double quotes does not split."""
    quoted = F.transform(
        F.split(line, f'\\{sep}(?=(?:[^"]*"[^"]*")*[^"]*$)'),
        lambda f: F.regexp_replace(F.trim(f), '^"|"$', ""),
    )
    plain = F.transform(F.split(line, f"\\{sep}"), lambda f: F.trim(f))
    return F.when(line.contains('"'), quoted).otherwise(plain)
