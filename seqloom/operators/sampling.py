"""Class balance by inverse-frequency weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.randomness import hash_uniform, whole_copies
from seqloom.operators.skew import EXPAND_BLOCK, expand_range


# The two classes. They bound every table of class counts that is broadcast here.
CLASSES = (0, 1)


def class_counts(
    windows: DataFrame, label: str = "label_binary", classes: Sequence[int] = CLASSES
) -> DataFrame:
    """Windows per class, at most one row for each of ``classes``.

    Any other label, NULL among them, fails the job instead of losing its windows.
    """
    counts = windows.groupBy(label).agg(F.count(F.lit(1)).alias("class_count"))
    named = F.coalesce(F.col(label).cast("string"), F.lit("NULL"))
    stop = F.raise_error(F.concat(F.lit(f"{label} holds a label outside its classes: "), named))
    known = F.when(F.col(label).isin(*classes), F.col("class_count")).otherwise(stop.cast("long"))
    return counts.select(label, known.alias("class_count"))


def _with_class(windows: DataFrame, table: DataFrame, label: str) -> DataFrame:
    """Attach a table with a row per class. A NULL label meets its row too, and so is not lost unseen."""
    table = table.withColumnRenamed(label, "_class")
    return windows.join(F.broadcast(table), F.col(label).eqNullSafe(F.col("_class"))).drop("_class")


def class_weights(windows: DataFrame, label: str = "label_binary") -> DataFrame:
    """Attach ``class_count`` and ``weight`` = 1 / class count.

    The counts are at most two rows and are broadcast; no row moves.
    """
    counts = class_counts(windows, label).withColumn("weight", F.lit(1.0) / F.col("class_count"))
    return _with_class(windows, counts, label)


def pos_weight(windows: DataFrame, label: str = "label_binary") -> DataFrame:
    """``positives, negatives, pos_weight``; neither count is taken as less than one."""
    positive = (F.col(label) == 1).cast("long")
    counts = windows.agg(
        F.coalesce(F.sum(positive), F.lit(0)).alias("positives"),
        F.coalesce(F.sum(1 - positive), F.lit(0)).alias("negatives"),
    )
    ratio = F.greatest("negatives", F.lit(1)) / F.greatest("positives", F.lit(1))
    return counts.withColumn("pos_weight", ratio)


def weighted_resample(
    windows: DataFrame, key: Column, seed: int, label: str = "label_binary"
) -> DataFrame:
    """Repeat windows so that every class is expected equally often.

    Each window is expected n * weight / sum of weights times, which for class weights is n /
    (classes * class count): it is repeated the whole part of that, and once more by a draw that depends
    on ``key`` and ``seed`` only. The sample has n rows in expectation. ``copy`` numbers the repeats
    from 1. The class counts, one row per class, are read once. Copies of a rare class are
    made in blocks that are spread over tasks.
    """
    counts = {row[label]: row["class_count"] for row in class_counts(windows, label).collect()}
    total = sum(counts.values())
    rates = {c: total / (len(counts) * n) for c, n in counts.items()}
    rate = F.lit(None).cast("double")
    for value, expected in rates.items():
        rate = F.when(F.col(label) == value, F.lit(expected)).otherwise(rate)
    drawn = windows.withColumn("_uniform", hash_uniform(key, seed))
    drawn = drawn.withColumn("_copies", whole_copies(rate, F.col("_uniform"))).where("_copies > 0")
    rare = [c for c, expected in rates.items() if expected > EXPAND_BLOCK]
    in_blocks = F.col(label).isin(*rare)
    first = F.lit(1).cast("long")
    out = drawn.where(~in_blocks).withColumn("copy", F.explode(F.sequence(first, "_copies")))
    if rare:
        spread = expand_range(drawn.where(in_blocks), F.col("_copies"), "copy", ["_uniform"])
        out = out.unionByName(spread.withColumn("copy", F.col("copy") + 1))
    return out.drop("_uniform", "_copies")


def stratified_sample(
    windows: DataFrame, key: Column, seed: int, label: str = "label_binary"
) -> DataFrame:
    """Without replacement: keep of each class the share that leaves as many as the rarest has.

    Shares come from the class counts, one row per class; rows are kept by a hash of ``key``.
    """
    counts = class_counts(windows, label)
    smallest = counts.agg(F.min("class_count").alias("_min")).withColumn("_one", F.lit(0))
    shares = (
        counts.withColumn("_one", F.lit(0))
        .join(F.broadcast(smallest), "_one")
        .select(label, (F.col("_min") / F.col("class_count")).alias("_share"))
    )
    return (
        _with_class(windows, shares, label)
        .where(hash_uniform(key, seed) < F.col("_share"))
        .drop("_share")
    )
