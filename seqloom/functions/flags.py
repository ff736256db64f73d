"""Quality-flag arrays of the manifest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sequences below / above these lengths are flagged.
VERY_SHORT_BELOW = 30
VERY_LONG_ABOVE = 3600


def _flag(condition: Column, name: str) -> Column:
    return F.when(condition, F.lit(name))


def flags_d(acoustic_len: Column, visual_len: Column) -> Column:
    """Flags of a corpus whose two modalities are both present, in a fixed order."""
    aligned = F.least(acoustic_len, visual_len)
    return F.array_compact(
        F.array(
            _flag(acoustic_len != visual_len, "length_mismatch"),
            _flag(aligned < VERY_SHORT_BELOW, "very_short"),
            _flag(aligned > VERY_LONG_ABOVE, "very_long"),
        )
    )


def flags_e(
    acoustic_len: Column,
    visual_len: Column,
    status: Column,
    warnings: Column,
    has_issue: Column,
) -> Column:
    """Flags of an extracted corpus: sorted, each at most once. A NULL length means no file."""
    aligned = F.least(acoustic_len, visual_len)
    fixed = F.array_compact(
        F.array(
            _flag(status == "partial", "partial_extraction"),
            _flag(has_issue, "corrupt_archive"),
            _flag(visual_len.isNull(), "missing_visual"),
            _flag(acoustic_len.isNull(), "missing_acoustic"),
            _flag(visual_len.isNull() & acoustic_len.isNull(), "not_extracted"),
            _flag(acoustic_len != visual_len, "length_mismatch"),
            _flag(aligned < VERY_SHORT_BELOW, "very_short"),
        )
    )
    warned = F.transform(
        F.coalesce(warnings, F.array().cast("array<string>")),
        lambda w: F.concat(F.lit("extract_warning:"), w),
    )
    return F.array_sort(F.array_distinct(F.concat(fixed, warned)))
