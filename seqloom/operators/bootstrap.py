"""Bootstrap intervals of subject-level metrics, all replicates in one job.

Each subject is taken a Poisson(1) number of times in each replicate. The number is a hash of
subject, replicate and seed, so it depends neither on partitioning nor on other subjects, and no
replicate is ever written out: copies are expanded inside the stage that reads the subjects and added
up at once, so what is shuffled is one row per group, replicate and calibration bin.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.metrics import bin_index, with_scores
from seqloom.operators.skew import work_partitions

#: Copies beyond this are as unlikely as one in 10 ** 10.
MOST_COPIES = 12
WORD = 1 << 32
# An odd step between replicates and the multiplier of the mixing rounds.
STEP, MULTIPLIER = 0x9E3779B1, 0x45D9F3B
METRICS = ("accuracy", "precision", "recall", "macro_f1", "weighted_f1", "brier_score", "ece")


def poisson_limits() -> list[int]:
    """A 32-bit hash that reaches the k-th limit stands for at least k copies."""
    total, out = 0.0, []
    for k in range(MOST_COPIES):
        total += math.exp(-1.0) / math.factorial(k)
        out.append(math.ceil(total * WORD))
    return [x for x in out if x < WORD]


def _mixed(x: Column) -> Column:
    return F.shiftrightunsigned(x, 16).bitwiseXOR(x) * F.lit(MULTIPLIER) % F.lit(WORD)


def with_copies(rows: DataFrame, high: str, low: str, replicate: str, out: str) -> DataFrame:
    """How often each row is taken in its replicate, from two 32-bit halves of a hashed key.

    Each step is a column of its own that the next one refers to; nested in one expression they
    would double with every step.
    """
    steps = rows.withColumn("_a", (F.col(low) + F.col(replicate) * F.lit(STEP)) % F.lit(WORD))
    steps = steps.withColumn("_b", _mixed(F.col("_a")).bitwiseXOR(F.col(high)))
    steps = steps.withColumn("_c", _mixed(F.col("_b")))
    steps = steps.withColumn("_d", F.shiftrightunsigned("_c", 16).bitwiseXOR(F.col("_c")))
    taken = F.lit(0).cast("long")
    for limit in poisson_limits():
        taken = taken + (F.col("_d") >= F.lit(limit)).cast("long")
    return steps.withColumn(out, taken).drop("_a", "_b", "_c", "_d")


def replicate_metrics(
    subjects: DataFrame,
    by: Sequence[str] = (),
    replicates: int = 1000,
    seed: int = 7,
    subject: str = "subject_id",
    bins: int = 10,
) -> DataFrame:
    """One row of metrics per group and replicate; replicate 0 is the data itself.

    Takes ``label, probability, prediction`` per subject. Subjects without a probability count as
    subjects and in the table of errors only.
    """
    half = F.md5(F.concat_ws(":", F.col(subject).cast("string"), F.lit(str(seed))))
    hashed = subjects.select(
        *by,
        "label",
        "probability",
        "prediction",
        bin_index(F.col("probability"), bins).alias("_bin"),
        *[F.conv(F.substring(half, at, 8), 16, 10).cast("long").alias(n) for at, n in ((1, "_high"), (9, "_low"))],
    )
    # A subject is a short row that stands for much work, so the number of partitions is fixed.
    hashed = hashed.repartition(work_partitions(subjects), "_low", "_high")
    r = F.col("replicate")
    expanded = hashed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates).cast("long"))).alias("replicate"))
    drawn = with_copies(expanded, "_high", "_low", "replicate", "_drawn")
    weighted = drawn.withColumn("_w", F.when(r == 0, 1).otherwise(F.col("_drawn")))
    w, p, y = F.col("_w"), F.col("probability"), F.col("label")
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    sums = weighted.groupBy(*by, "replicate", "_bin").agg(
        F.sum(w).alias("_n"),
        *[
            F.sum(F.when((y == a) & (F.col("prediction") == b), w).otherwise(0)).alias(name)
            for name, (a, b) in cells.items()
        ],
        F.sum(w * (p - y) * (p - y)).alias("_square"),
        F.sum(F.when(p.isNotNull(), w)).alias("_known"),
        F.abs(F.sum(w * y) - F.sum(w * p)).alias("_gap"),
    )
    total = sums.groupBy(*by, "replicate").agg(
        F.sum("_n").alias("num_subjects"),
        *[F.sum(c).alias(c) for c in cells],
        (F.sum("_square") / F.sum("_known")).alias("brier_score"),
        (F.coalesce(F.sum(F.when(F.col("_bin").isNotNull(), F.col("_gap"))), F.lit(0.0)) / F.sum("_n")).alias("ece"),
    )
    scored = with_scores(total.withColumn("accuracy", (F.col("tn") + F.col("tp")) / F.col("num_subjects")))
    return scored.select(*by, "replicate", *METRICS)


def bootstrap_intervals(
    subjects: DataFrame,
    by: Sequence[str] = (),
    replicates: int = 1000,
    level: float = 0.95,
    seed: int = 7,
    metrics: Sequence[str] = METRICS,
    **options,
) -> DataFrame:
    """``metric, estimate, low, high, std, replicates`` per group: percentile intervals.

    ``replicates`` counts those in which the metric is defined. At most ``replicates`` values meet
    in one task for each metric and group.
    """
    unknown = [m for m in metrics if m not in METRICS]
    if unknown:
        raise ValueError(f"No intervals are made for {', '.join(unknown)}")
    rows = replicate_metrics(subjects, by, replicates, seed, **options)
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    long = rows.select(*by, "replicate", F.explode(entries).alias("_e")).select(*by, "replicate", "_e.metric", "_e.value")
    drawn = F.when(F.col("replicate") > 0, F.col("value"))
    tail = (1.0 - level) / 2
    return long.groupBy(*by, "metric").agg(
        F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("estimate"),
        F.percentile(drawn, tail).alias("low"),
        F.percentile(drawn, 1.0 - tail).alias("high"),
        F.stddev_pop(drawn).alias("std"),
        F.count(drawn).alias("replicates"),
    )
