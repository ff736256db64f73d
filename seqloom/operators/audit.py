"""Corpus audits: one small result table per check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import labels as L
from seqloom.functions.vectors import has_inf, has_nan
from seqloom.operators.quantile import exact_quantiles

# Feature widths by corpus and modality.
EXPECTED_WIDTHS = {
    ("dvlog", "acoustic"): 25,
    ("dvlog", "visual"): 136,
    ("edaic", "acoustic"): 23,
    ("edaic", "visual"): 49,
}


def _total(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


# --- counts over label tables ---------------------------------------------------------------------


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of every value of each column in one pass: ``attribute, value, count``."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    sets = [[F.col(c)] for c in columns]
    counted = texts.groupingSets(sets, *[F.col(c) for c in columns]).agg(
        F.count(F.lit(1)).alias("count"), *[F.grouping(c).alias(f"_g_{c}") for c in columns]
    )
    attribute, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in columns:
        here = F.col(f"_g_{c}") == 0
        attribute = F.when(here, F.lit(c)).otherwise(attribute)
        value = F.when(here, F.col(c)).otherwise(value)
    return counted.select(attribute.alias("attribute"), value.alias("value"), "count")


def fold_label_counts(df: DataFrame, fold: str = "fold", label: str = "label") -> DataFrame:
    return df.groupBy(fold, label).agg(F.count(F.lit(1)).alias("count"))


def split_rates(df: DataFrame, split: str = "fold", label: str = "label_binary") -> DataFrame:
    """``total, positives, rate`` per split; the rate is rounded half to even at three digits."""
    counted = df.groupBy(split).agg(
        F.count(F.lit(1)).alias("total"), _total(F.col(label) == 1).alias("positives")
    )
    return counted.withColumn("rate", F.bround(F.col("positives") / F.col("total"), 3))


def numeric_stats(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """``min, max, mean, median, std`` (population) of one numeric column; NULL and NaN are left out.

    Values are counted first and the counts stored, so the input is read once. The median is found by
    running counts over the ordered values, so a column may have any number of distinct ones and a
    group any size.
    """
    n, x = F.col("_n"), F.col("_v")
    kind = df.schema[column].dataType
    mean = F.sum(x * n) / F.sum(n)
    further = [
        F.min(x).cast(kind).alias("min"),
        F.max(x).cast(kind).alias("max"),
        mean.alias("mean"),
        F.sqrt(F.greatest(F.sum(x * x * n) / F.sum(n) - F.pow(mean, F.lit(2.0)), F.lit(0.0))).alias("std"),
    ]
    found = exact_quantiles(df, column, {"median": 0.5}, by, also=further)
    return found.select(*by, "min", "max", "mean", "median", "std")


def severity_histogram(df: DataFrame, score: str = "phq") -> DataFrame:
    """Subjects per severity band, empty bands kept, in band order."""
    band = L.severity_band(F.col(score))
    names = [name for name, _ in L.SEVERITY_BANDS]
    totals = df.agg(*[_total(band == name).alias(f"b{i}") for i, name in enumerate(names)])
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("band_order"), F.lit(name).alias("band"), F.col(f"b{i}").alias("count"))
            for i, name in enumerate(names)
        ]
    )
    return totals.select(F.explode(rows).alias("_r")).select("_r.*")


def session_counts(
    df: DataFrame, participant: str = "subject_id", ai_from: int = L.AI_SESSION_FROM
) -> DataFrame:
    return df.groupBy(L.session_type(F.col(participant), ai_from).alias("session_type")).agg(
        F.count(F.lit(1)).alias("count")
    )


# --- checks over frames ---------------------------------------------------------------------------


def sequence_shapes(
    frames: DataFrame, features: str = "features", keys: Sequence[str] = ("subject_id", "modality")
) -> DataFrame:
    """``len, dim`` per sequence; only the size of each vector is looked at."""
    return frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("len"), F.max(F.size(features)).alias("dim")
    )


def modality_shapes(shapes: DataFrame, key: str = "subject_id") -> DataFrame:
    """One row per subject: lengths and widths side by side, with the aligned length."""
    columns = []
    for name in ("acoustic", "visual"):
        here = F.col("modality") == name
        columns.append(F.max(F.when(here, F.col("len"))).alias(f"{name}_len"))
        columns.append(F.max(F.when(here, F.col("dim"))).alias(f"{name}_dim"))
    wide = shapes.groupBy(key).agg(*columns)
    return wide.withColumn(
        "aligned_len", L.aligned_length(F.col("visual_len"), F.col("acoustic_len"))
    )


def length_stats(wide: DataFrame) -> DataFrame:
    """Summary of aligned, acoustic and visual lengths of subjects that have both modalities."""
    both = wide.where(F.col("acoustic_len").isNotNull() & F.col("visual_len").isNotNull())
    parts = F.array(
        *[
            F.struct(F.lit(n).alias("measure"), F.col(f"{n}_len").alias("len"))
            for n in ("aligned", "acoustic", "visual")
        ]
    )
    return numeric_stats(both.select(F.explode(parts).alias("_p")).select("_p.*"), "len", ["measure"])


def length_mismatches(wide: DataFrame, key: str = "subject_id") -> DataFrame:
    different = F.col("acoustic_len") != F.col("visual_len")
    return wide.where(different).select(
        key,
        "acoustic_len",
        "visual_len",
        F.abs(F.col("acoustic_len") - F.col("visual_len")).alias("diff"),
    )


def nan_inf(
    frames: DataFrame, features: str = "features", keys: Sequence[str] = ("subject_id", "modality")
) -> DataFrame:
    return frames.groupBy(*keys).agg(
        F.bool_or(has_nan(F.col(features))).alias("has_nan"),
        F.bool_or(has_inf(F.col(features))).alias("has_inf"),
    )


def dimension_issues(
    shapes: DataFrame, expected: Mapping[str, int], modality: str = "modality"
) -> DataFrame:
    """Sequences whose width is not the one expected for their modality."""
    width = F.lit(None).cast("int")
    for name, value in expected.items():
        width = F.when(F.col(modality) == name, F.lit(value)).otherwise(width)
    return (
        shapes.withColumn("expected_dim", width)
        .where(F.col("dim") != F.col("expected_dim"))
        .withColumnRenamed("dim", "actual_dim")
    )


def array_issues(arrays: DataFrame, expected: str = "float64") -> DataFrame:
    """``subject_id, modality, issue, dtype``: files without a readable header (``corrupt``) and those of
    another element type (``dtype``); ``arrays`` is a listing of headers with their errors."""
    damaged = F.col("error").isNotNull()
    issue = F.when(damaged, "corrupt").when(F.col("dtype") != expected, "dtype")
    listed = arrays.select("subject_id", "modality", issue.alias("issue"), "dtype")
    return listed.where(F.col("issue").isNotNull())


# --- cross references -----------------------------------------------------------------------------


def missing_from(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks.

    Both sides are made distinct first: that combines before the shuffle, so a key that fills a
    large part of either table does not load one task of the join.
    """
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def with_label_or_unknown(
    stats: DataFrame, labels: DataFrame, key: str, columns: Sequence[str] = ("label", "fold")
) -> DataFrame:
    joined = stats.join(labels.select(key, *columns), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit("unknown")) for c in columns})


def video_presence(links: DataFrame, downloaded: DataFrame) -> DataFrame:
    """``video_id, key, has_raw_video``; ``downloaded`` has one row per key."""
    present = downloaded.select("key").distinct().withColumn("_there", F.lit(True))
    return links.join(present, "key", "left").select(
        "video_id", "key", F.coalesce("_there", F.lit(False)).alias("has_raw_video")
    )


def video_coverage(links: DataFrame, downloaded: DataFrame) -> DataFrame:
    presence = video_presence(links, downloaded)
    counts = presence.agg(
        F.count(F.lit(1)).alias("total_linked"),
        _total(F.col("has_raw_video")).alias("subjects_with_video"),
        _total(~F.col("has_raw_video")).alias("subjects_without_video"),
    )
    stored = downloaded.agg(F.count_distinct("key").alias("videos_downloaded"))
    # two one-row tables
    one = F.lit(0).alias("_one")
    return counts.select("*", one).join(stored.select("*", one), "_one").drop("_one")


def id_range(ids: DataFrame, column: str) -> DataFrame:
    return ids.agg(
        F.count(F.lit(1)).alias("total"), F.min(column).alias("first"), F.max(column).alias("last")
    )


def fold_overlap(
    members: DataFrame, folds: Sequence[str], key: str = "subject_id", fold: str = "fold"
) -> DataFrame:
    """Subjects shared by each pair of folds, PASS or FAIL, and the number of subjects overall."""
    seen = members.groupBy(key).agg(
        *[F.bool_or(F.col(fold) == f).alias(f"in_{f}") for f in folds]
    )
    pairs = list(combinations(folds, 2))
    counts = seen.agg(
        *[
            _total(F.col(f"in_{a}") & F.col(f"in_{b}")).alias(f"n_{a}_{b}")
            for a, b in pairs
        ],
        F.count(F.lit(1)).alias("total_subjects"),
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("fold_a"), F.lit(b).alias("fold_b"), F.col(f"n_{a}_{b}").alias("overlap")
            )
            for a, b in pairs
        ]
    )
    return counts.select(F.explode(rows).alias("_r"), "total_subjects").select(
        "_r.*",
        F.when(F.col("_r.overlap") == 0, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
        "total_subjects",
    )


def corpus_overlap(first: DataFrame, second: DataFrame, key: str = "subject_id") -> DataFrame:
    return first.select(key).distinct().intersect(second.select(key).distinct())


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once in a label table."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)


# --- extraction -----------------------------------------------------------------------------------


def quality_columns(threshold: float = 0.5) -> list[Column]:
    """Aggregates: mean confidence, share of low-confidence frames, share of tracked frames."""
    return [
        F.avg("confidence").alias("confidence_mean"),
        F.avg((F.col("confidence") < threshold).cast("double")).alias("low_confidence_ratio"),
        F.avg((F.col("success") > 0).cast("double")).alias("success_ratio"),
    ]


def extraction_quality(
    frames: DataFrame, key: str = "subject_id", threshold: float = 0.5
) -> DataFrame:
    return frames.groupBy(key).agg(*quality_columns(threshold))


STATUSES = ("success", "partial", "failed", "skipped")


def extraction_report(results: DataFrame, status: str = "status") -> DataFrame:
    """Subjects per outcome, outcomes that did not occur included."""
    totals = results.agg(*[_total(F.col(status) == s).alias(s) for s in STATUSES])
    rows = F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("count")) for s in STATUSES])
    return totals.select(F.explode(rows).alias("_r")).select("_r.*")


def extraction_errors(results: DataFrame, status: str = "status") -> DataFrame:
    """Everything that needs a look: partial and failed subjects."""
    return results.where(F.col(status).isin("partial", "failed"))


def extraction_summary(results: DataFrame) -> DataFrame:
    """Outcome counts, the widths met and the mean lengths, per modality where it applies."""
    return results.agg(
        _total(F.col("status") == "success").alias("complete"),
        _total(F.col("status") == "partial").alias("partial"),
        _total(~F.col("status").isin("success", "partial", "skipped")).alias("failed"),
        F.array_sort(F.collect_set("visual_dim")).alias("visual_dims"),
        F.array_sort(F.collect_set("acoustic_dim")).alias("acoustic_dims"),
        F.avg("visual_len").alias("visual_len_mean"),
        F.avg("acoustic_len").alias("acoustic_len_mean"),
    )


# --- window labels --------------------------------------------------------------------------------


def window_label_distribution(
    windows: DataFrame,
    fold: str = "fold",
    label: str = "label_binary",
    key: str = "subject_id",
) -> DataFrame:
    """Windows and subjects per fold and class; subjects are counted from a per-subject grouping."""
    per_subject = windows.groupBy(fold, key).agg(
        F.min(label).alias(label), F.count(F.lit(1)).alias("_w")
    )
    positive = F.col(label) == 1
    return per_subject.groupBy(fold).agg(
        F.sum("_w").alias("windows"),
        F.coalesce(F.sum(F.when(positive, F.col("_w"))), F.lit(0)).alias("windows_positive"),
        F.count(F.lit(1)).alias("subjects"),
        _total(positive).alias("subjects_positive"),
    )
