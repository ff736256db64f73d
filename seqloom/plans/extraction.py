"""Archives to frames and per-subject metadata."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import labels as L
from seqloom.operators.audit import quality_columns
from seqloom.operators.skew import join_spread
from seqloom.sources import archives as A
from seqloom.sources import readers as R

# Fixed value: results of other versions are extracted again.
EXTRACTOR_VERSION = "2.0"

# What tells one member of one archive from all others of its kind.
_MEMBER = ["participant", "archive", "member"]


@dataclass
class Extraction:
    visual: DataFrame
    acoustic: DataFrame
    metadata: DataFrame


def _headers(staged: DataFrame, kind: str, sep: str) -> DataFrame:
    """The first line of each whole member, which is all that tells its other lines from cut ones."""
    first = staged.where(
        (F.col("record") == "line") & (F.col("kind") == kind) & (F.col("line_no") == 0)
    )
    head = first.join(A.whole_members(staged), ["participant", "archive", "kind", "member"])
    return head.select(*_MEMBER, R.split_fields(F.col("line"), sep).alias("header"))


def _positions(names: Column) -> Column:
    return F.transform(names, lambda n: F.array_position("header", n).cast("int"))


def _parsed(staged: DataFrame, kind: str, heads: DataFrame, sep: str) -> DataFrame:
    """Numeric fields at the header's ``positions``; rows with an unreadable field are dropped.

    Headers come from whole members only, so the join that brings the positions also leaves out
    lines of members cut short. The line is split once and bound to a lambda variable, and the parsed row comes out of a
    generator, so that neither is evaluated again for every field that is used.
    """
    body = staged.where(
        (F.col("record") == "line") & (F.col("kind") == kind) & (F.col("line_no") > 0)
    ).select(*_MEMBER, "line_no", "line")
    placed = join_spread(body, heads, _MEMBER, "line_no")
    parsed = F.transform(
        F.array(R.split_fields(F.col("line"), sep)),
        lambda values: F.transform(
            F.col("positions"), lambda p: L.tolerant_double(F.get(values, p - 1))
        ),
    )
    readable = F.filter(parsed, lambda fields: ~F.exists(fields, lambda x: x.isNull()))
    return placed.select("participant", "line_no", F.explode(readable).alias("fields"))


def parse_visual(staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(frames, headers)``; a header that lacks required columns yields no frames."""
    required = F.array(*[F.lit(c) for c in R.VISUAL_REQUIRED])
    heads = _headers(staged, "visual", ",").select(
        *_MEMBER,
        F.array_sort(F.array_except(required, F.col("header"))).alias("missing"),
        _positions(required).alias("positions"),
    )
    usable = heads.where(F.size("missing") == 0).drop("missing")
    rows = _parsed(staged, "visual", usable, ",")
    frames = rows.select(
        "participant",
        F.col("fields")[0].cast("float").alias("ts"),
        F.slice("fields", 4, len(R.VISUAL_FEATURES)).cast("array<float>").alias("features"),
        F.col("fields")[1].cast("float").alias("confidence"),
        F.col("fields")[2].cast("int").alias("success"),
    )
    return frames, heads.select("participant", "missing")


def parse_acoustic(staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As :func:`parse_visual`; the features are whatever columns the header lists."""
    metadata = F.array(*[F.lit(c) for c in R.ACOUSTIC_METADATA])
    time = F.array(F.lit(R.ACOUSTIC_TIME))
    features = F.filter("header", lambda n: ~F.array_contains(metadata, n))
    heads = _headers(staged, "acoustic", ";").select(
        *_MEMBER,
        F.array_except(time, F.col("header")).alias("missing"),
        _positions(F.concat(time, features)).alias("positions"),
    )
    usable = heads.where(F.size("missing") == 0).drop("missing")
    rows = _parsed(staged, "acoustic", usable, ";")
    frames = rows.select(
        "participant",
        F.col("fields")[0].cast("float").alias("ts"),
        F.slice("fields", F.lit(2), F.size("fields") - 1).cast("array<float>").alias("features"),
    )
    return frames, heads.select("participant", "missing")


def _availability(
    heads: DataFrame, frames: DataFrame, kind: str, quality: Sequence[Column] = ()
) -> DataFrame:
    shape = frames.groupBy("participant").agg(
        F.count(F.lit(1)).alias("_rows"), F.max(F.size("features")).alias("_width"), *quality
    )
    extra = [c for c in shape.columns if not c.startswith("_") and c != "participant"]
    complaint = F.concat(
        F.lit(f"{kind}_parse_error: Missing columns: "), F.array_join("missing", ", ")
    )
    return heads.join(shape, "participant", "left").select(
        "participant",
        (F.size("missing") == 0).alias(f"{kind}_available"),
        F.coalesce("_rows", F.lit(0)).alias(f"{kind}_len"),
        F.col("_width").alias(f"{kind}_dim"),
        F.when(F.size("missing") > 0, complaint).alias(f"_{kind}_error"),
        *extra,
    )


def extract(archives: DataFrame) -> Extraction:
    """Frames of both modalities and one metadata row per archive, damaged archives included."""
    staged = A.stage_payloads(archives)
    visual, visual_heads = parse_visual(staged)
    acoustic, acoustic_heads = parse_acoustic(staged)
    joined = (
        archives.select("participant", "archive")
        .join(A.distinct_warnings(staged), "participant", "left")
        .join(_availability(visual_heads, visual, "visual", quality_columns()), "participant", "left")
        .join(_availability(acoustic_heads, acoustic, "acoustic"), "participant", "left")
    )
    has = {k: F.coalesce(F.col(f"{k}_available"), F.lit(False)) for k in ("visual", "acoustic")}
    status = L.extraction_status(has["visual"], has["acoustic"])
    outcome = F.when(status == "partial", F.lit("partial_subject_recovered")).when(
        status == "failed", F.lit("no_required_features_recovered")
    )
    warnings = F.array_distinct(
        F.array_compact(
            F.concat(
                F.coalesce("warnings", F.array().cast("array<string>")),
                F.array(F.col("_visual_error"), F.col("_acoustic_error"), outcome),
            )
        )
    )
    metadata = joined.select(
        F.concat(F.col("participant").cast("string"), F.lit("_P")).alias("subject_id"),
        "archive",
        F.lit(EXTRACTOR_VERSION).alias("extractor_version"),
        status.alias("status"),
        warnings.alias("warnings"),
        has["visual"].alias("visual_available"),
        has["acoustic"].alias("acoustic_available"),
        *[f"{k}_{part}" for k in ("visual", "acoustic") for part in ("len", "dim")],
        "confidence_mean",
        "low_confidence_ratio",
        "success_ratio",
    )
    return Extraction(visual, acoustic, metadata)


def complete_subjects(metadata: DataFrame) -> DataFrame:
    """Subjects that need no further work: extracted in full by this version."""
    done = (F.col("status") == "success") & (F.col("extractor_version") == EXTRACTOR_VERSION)
    return metadata.where(done).select("subject_id")


def pending_archives(archives: DataFrame, metadata: DataFrame) -> DataFrame:
    tagged = archives.withColumn(
        "subject_id", F.concat(F.col("participant").cast("string"), F.lit("_P"))
    )
    return tagged.join(complete_subjects(metadata), "subject_id", "left_anti").drop("subject_id")
