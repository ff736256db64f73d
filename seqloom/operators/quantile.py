"""Exact quantiles of columns of any size: counts by value, then running counts, no group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.skew import ONE_TASK_ROWS, ordered_prefix


def exact_quantiles(
    df: DataFrame,
    column: str,
    names: Mapping[str, float],
    by: Sequence[str] = (),
    one_task_rows: int | None = None,
    also: Sequence[Column] = (),
) -> DataFrame:
    """One column per entry of ``names`` (name: fraction), interpolated between neighbours.

    NULL and NaN values are left out; a group of nothing else gives no row. Also returns ``count``.
    ``also`` are further aggregates over the counted values: ``_v``, a double, stands ``_n`` times.
    """
    value = F.col(column).cast("double")
    counts = (
        df.select(*by, value.alias("_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*by, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = ordered_prefix(counts, by, F.col("_v"), ["_n"], ["_v"], ONE_TASK_ROWS if one_task_rows is None else one_task_rows)
    low, high = F.col("before__n"), F.col("before__n") + F.col("_n")

    def at(fraction: float):
        place = (F.col("total__n") - 1) * F.lit(float(fraction))
        whole = F.floor(place)
        here = (whole >= low) & (whole < high)
        upper = F.when(whole + 1 < high, F.col("_v")).otherwise(F.coalesce("next__v", "_v"))
        return F.max(F.when(here, F.col("_v") + (upper - F.col("_v")) * (place - whole)))

    return ranked.groupBy(*by).agg(
        F.sum("_n").alias("count"), *[at(q).alias(name) for name, q in names.items()], *also
    )


def robust_centre(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """``median`` and ``mad``, the median absolute deviation, per group."""
    keys = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    centre = exact_quantiles(rows, column, {"median": 0.5}, keys).drop("count")
    # one row per group: Spark broadcasts it while it is small, else splits skewed keys
    away = rows.join(centre, keys).withColumn("_away", F.abs(F.col(column) - F.col("median")))
    spread = exact_quantiles(away, "_away", {"mad": 0.5}, keys).drop("count")
    return centre.join(spread, keys).select(*by, "median", "mad")
