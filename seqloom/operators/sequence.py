"""Irregular frames to fixed time bins: resample, fill gaps, trim, align.

A sequence is sparse: one row per bin that holds at least one frame, with ``sec`` counted from 0.
A missing bin is an invalid bin of zeros; it is only written out by :func:`fill_gaps` or inside
a window matrix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.vectors import zeros
from seqloom.operators.skew import expand_range, join_spread

KEYS = ("subject_id",)


def mean_vector(features: str, width: int) -> Column:
    """Aggregate: element-wise mean of an array column, at any width over the elements that are not NULL."""
    return F.array(*[F.avg(F.get(F.col(features), i)) for i in range(width)])


def resample(
    frames: DataFrame,
    width: int,
    *,
    keys: Sequence[str] = KEYS,
    ts: str = "ts",
    features: str = "features",
    bin_seconds: float = 1.0,
    quality: str | None = None,
    success: str | None = None,
    quality_threshold: float = 0.5,
) -> DataFrame:
    """Mean feature vector per bin, ``keys, sec, features, valid``.

    A bin is valid if the mean quality reaches the threshold and the mean success exceeds one
    half; a check whose column is absent (or NULL throughout the bin) passes. Timestamps are
    taken at single precision; frames before 0 or at no finite time are dropped.
    """
    stamp = F.col(ts).cast("float")
    if bin_seconds != 1.0:
        stamp = stamp / F.lit(bin_seconds).cast("float")
    checks = F.lit(True)
    if quality is not None:
        checks = checks & (F.coalesce(F.avg(quality), F.lit(1.0)) >= quality_threshold)
    if success is not None:
        checks = checks & (F.coalesce(F.avg(success), F.lit(1.0)) > 0.5)
    return (
        frames.withColumn("sec", F.floor(stamp).cast("long"))
        .where(~F.isnan(stamp) & (stamp < F.lit(float("inf"))) & (F.col("sec") >= 0))
        .groupBy(*keys, "sec")
        .agg(mean_vector(features, width).alias("features"), checks.alias("valid"))
    )


def lengths(seq: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bins per sequence, gaps included: ``keys, len``."""
    return seq.groupBy(*keys).agg((F.max("sec") + 1).alias("len"))


def fill_gaps(seq: DataFrame, width: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every bin from 0 to the last one; missing bins are zeros and invalid."""
    spine = expand_range(lengths(seq, keys), F.col("len"), "sec", keys).drop("len")
    return spine.join(seq, [*keys, "sec"], "left").select(
        *keys,
        "sec",
        F.coalesce(F.col("features"), zeros(width)).alias("features"),
        F.coalesce(F.col("valid"), F.lit(False)).alias("valid"),
    )


def valid_bounds(seq: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """First and last valid bin, one row per sequence that has any: ``keys, first, last``."""
    return (
        seq.where("valid")
        .groupBy(*keys)
        .agg(F.min("sec").alias("first"), F.max("sec").alias("last"))
    )


def cut_to(seq: DataFrame, bounds: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keep bins between ``first`` and ``last`` and count ``sec`` from ``first``.

    Sequences without a row in ``bounds`` disappear; further columns of ``bounds`` are attached, so
    filtering by length and labelling cost no join of their own.
    """
    return (
        join_spread(seq, bounds, keys, "sec", last=F.col("last"))
        .where(F.col("sec").between(F.col("first"), F.col("last")))
        .withColumn("sec", F.col("sec") - F.col("first"))
        .drop("first", "last")
    )


def trim_invalid(seq: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cut before the first and after the last valid bin; count ``sec`` from the first one.

    Sequences without a valid bin disappear.
    """
    return cut_to(seq, valid_bounds(seq, keys), keys)


def align(
    first: DataFrame,
    second: DataFrame,
    widths: tuple[int, int],
    names: tuple[str, str] = ("visual", "acoustic"),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Two modalities on one time axis, cut to the shorter: ``keys, sec, <a>, <b>, valid``.

    A bin is valid where both are. Sequences that lack one modality disappear.
    """
    shared = (
        lengths(first, keys)
        .join(lengths(second, keys).withColumnRenamed("len", "_other"), list(keys))
        .select(*keys, F.least("len", "_other").alias("_len"))
    )

    def side(seq: DataFrame, name: str) -> DataFrame:
        return (
            join_spread(seq, shared, keys, "sec")
            .where(F.col("sec") < F.col("_len"))
            .select(*keys, "sec", F.col("features").alias(name), F.col("valid").alias(f"_v_{name}"))
        )

    left, right = (side(seq, name) for seq, name in zip((first, second), names))
    valid = [F.coalesce(F.col(f"_v_{name}"), F.lit(False)) for name in names]
    return left.join(right, [*keys, "sec"], "full").select(
        *keys,
        "sec",
        *[F.coalesce(F.col(n), zeros(w)).alias(n) for n, w in zip(names, widths)],
        (valid[0] & valid[1]).alias("valid"),
    )


def cap_length(seq: DataFrame, max_len: int = 3600) -> DataFrame:
    return seq.where(F.col("sec") < max_len)


def drop_short(seq: DataFrame, min_len: int = 15, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keep sequences of at least ``min_len`` bins."""
    kept = lengths(seq, keys).where(F.col("len") >= min_len).drop("len")
    return join_spread(seq, kept, keys, "sec")
