"""Label, demographic and status columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severity bands of the eight-item score, upper bound inclusive.
SEVERITY_BANDS = (
    ("0-4_minimal", 4),
    ("5-9_mild", 9),
    ("10-14_moderate", 14),
    ("15-19_mod_severe", 19),
    ("20-27_severe", None),
)
# Age groups of slice reports, both bounds inclusive.
AGE_BUCKETS = (("18-30", 18, 30), ("31-45", 31, 45), ("46-60", 46, 60), ("61+", 61, None))
# First participant number of the automated sessions, prefix of the item columns.
AI_SESSION_FROM = 492
PHQ_PREFIX = "PHQ8_"


def label_binary(label: Column, positive: str = "depression") -> Column:
    return F.coalesce((label == F.lit(positive)).cast("int"), F.lit(0))


def fold_alias(fold: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Rename folds, by default ``valid`` to ``dev``."""
    result = fold
    for source, target in (aliases or {"valid": "dev"}).items():
        result = F.when(fold == source, F.lit(target)).otherwise(result)
    return result


def tolerant_int(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("int")


def tolerant_double(value: Column) -> Column:
    """NULL unless the trimmed text is a number; a type suffix such as ``1.5f`` is not."""
    text = F.trim(value.cast("string"))
    lower = F.lower(text)
    suffixed = lower.endswith("d") | (lower.endswith("f") & ~lower.endswith("inf"))
    return F.when(~suffixed, text.try_cast("double"))


def age_or_unknown(age: Column) -> Column:
    """Whole years, -1 where the field is empty or not a number."""
    return F.coalesce(tolerant_int(age), F.lit(-1))


def phq_columns(df: DataFrame) -> list[str]:
    """One column per item, found by prefix; the first match of each item counts."""
    found = []
    for item in range(1, 9):
        matches = [name for name in df.columns if name.startswith(f"{PHQ_PREFIX}{item}_")]
        found.extend(matches[:1])
    return found


def phq_total(items: Sequence[Column]) -> Column:
    """Sum of the item scores; a missing or unreadable item adds nothing."""
    total = F.lit(0)
    for item in items:
        total = total + F.coalesce(tolerant_int(item), F.lit(0))
    return total


def severity_band(score: Column) -> Column:
    band = F.lit(SEVERITY_BANDS[-1][0])
    for name, upper in reversed(SEVERITY_BANDS[:-1]):
        band = F.when(score <= upper, F.lit(name)).otherwise(band)
    return band


def age_bucket(age: Column) -> Column:
    """Age group of a report; ages below the first group, and unknown ones, are ``unknown``."""
    bucket = F.lit("unknown")
    for name, low, high in reversed(AGE_BUCKETS):
        inside = (age >= low) if high is None else age.between(low, high)
        bucket = F.when(inside, F.lit(name)).otherwise(bucket)
    return bucket


def session_type(participant: Column, ai_from: int = AI_SESSION_FROM) -> Column:
    return F.when(participant >= ai_from, F.lit("ai")).otherwise(F.lit("woz"))


def extraction_status(has_visual: Column, has_acoustic: Column) -> Column:
    return (
        F.when(has_visual & has_acoustic, F.lit("success"))
        .when(has_visual | has_acoustic, F.lit("partial"))
        .otherwise(F.lit("failed"))
    )


def aligned_length(visual_len: Column, acoustic_len: Column) -> Column:
    """Shorter of the two lengths, the one that exists, or NULL."""
    return F.least(visual_len, acoustic_len)
