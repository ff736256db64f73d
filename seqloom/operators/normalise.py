"""Train-only standardisation of feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.vectors import standardise
from seqloom.operators.skew import broadcast_if_small

VAR_FLOOR = 1e-8
SOURCES = ("train", "provided")
# 256 groups of 136 dimensions are about half a megabyte
MAX_GROUPS = 256


def fit_stats(
    seq: DataFrame,
    width: int,
    *,
    by: Sequence[str] = (),
    features: str = "features",
    valid_only: bool = True,
    var_floor: float = VAR_FLOOR,
) -> DataFrame:
    """``by, n, mean array, std array``: population deviation with a floor under the variance.

    One row per group. ``valid_only`` leaves invalid bins out (corpus E); corpus D counts all
    aligned frames. NULL elements are skipped, whatever the width.
    """
    rows = seq.where("valid") if valid_only else seq
    count = F.count(F.lit(1)).alias("n")
    x = [F.get(F.col(features), i).cast("double") for i in range(width)]
    moments = rows.groupBy(*by).agg(
        count,
        F.array(*[F.avg(c) for c in x]).alias("mean"),
        F.array(*[F.var_pop(c) for c in x]).alias("_var"),
    )
    floor = F.lit(float(var_floor))
    return moments.where(F.col("n") > 0).select(
        *by, "n", "mean", F.transform("_var", lambda v: F.sqrt(F.greatest(v, floor))).alias("std")
    )


def stats_long(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, dim, mean, std``: one row per dimension."""
    return stats.select(*by, F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "_s")).select(
        *by, "dim", F.col("_s.mean").alias("mean"), F.col("_s.std").alias("std")
    )


def stats_from_long(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Back to one row of arrays per group; a group has as many rows as dimensions."""
    ordered = F.array_sort(F.collect_list(F.struct("dim", "mean", "std")))
    return stats.groupBy(*by).agg(ordered.alias("_d")).select(
        *by, F.col("_d.mean").alias("mean"), F.col("_d.std").alias("std")
    )


def join_stats(seq: DataFrame, stats: DataFrame, on: Sequence[str]) -> DataFrame:
    """Attach the statistics of each row's group.

    There is one row per group (corpus and modality), each a few hundred numbers wide. They are
    computed once; up to ``MAX_GROUPS`` rows they are broadcast and no row of ``seq`` moves.
    """
    return seq.join(broadcast_if_small(stats.select(*on, "mean", "std"), MAX_GROUPS), list(on))


def apply_stats(
    seq: DataFrame, stats: DataFrame, on: Sequence[str], features: str = "features"
) -> DataFrame:
    """Standardised features; also keeps ``gap_row``, the standardised zero vector."""
    joined = join_stats(seq, stats, on)
    zero = F.transform("mean", lambda m: F.lit(0.0))
    return joined.withColumns(
        {
            features: standardise(F.col(features), F.col("mean"), F.col("std")),
            "gap_row": standardise(zero, F.col("mean"), F.col("std")),
        }
    ).drop("mean", "std")


def load_stats(stats_table: DataFrame, source: str) -> DataFrame:
    """Rows of a stored statistics table from one source."""
    if source not in SOURCES:
        raise ValueError(f"Statistics cannot come from {source}")
    return stats_table.where(F.col("source") == source)


def stats_for_fold(fold: str, train_stats: DataFrame | None, fit) -> DataFrame:
    """Stored train statistics if there are any; only the train fold may compute them."""
    if train_stats is not None:
        return train_stats
    if fold != "train":
        raise ValueError(f"Statistics of the training fold must be given to normalise fold {fold!r}.")
    return fit()


def stats_shape(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Width of each stored vector and whether the table has it at all."""
    return stats.groupBy(*by).agg(
        F.count("mean").alias("mean_dims"), F.count("std").alias("std_dims")
    )


def normalised_has_nan(seq: DataFrame, by: Sequence[str] = (), features: str = "features") -> DataFrame:
    return seq.groupBy(*by).agg(F.bool_or(_nan(F.col(features))).alias("has_nan"))


def _nan(features: Column) -> Column:
    return F.exists(features, lambda x: F.isnan(x))
