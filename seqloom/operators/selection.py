"""Summaries over seeds, choice of method and candidate, leaderboards, early stopping.

Inputs are experiment records: one row per run, never per window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRIDE_POLICIES = ("half_window", "fixed_15")


# --- configuration --------------------------------------------------------------------------------


def stride_for(size: Column | int, policy: str):
    """Stride of a window size; a plain number gives a plain number."""
    if policy not in STRIDE_POLICIES:
        raise ValueError(f"No stride rule is called {policy}")
    if policy == "fixed_15":
        return F.lit(15) if isinstance(size, Column) else 15
    if isinstance(size, Column):
        return F.greatest(F.lit(1), F.floor(size / 2)).cast("int")
    return max(1, size // 2)


def merge_config(base: Mapping, override: Mapping) -> dict:
    """Override on top of base; nested mappings are merged, everything else replaced."""
    merged = dict(base)
    for key, value in override.items():
        nested = isinstance(value, Mapping) and isinstance(merged.get(key), Mapping)
        merged[key] = merge_config(merged[key], value) if nested else value
    return merged


def merged_columns(fields: Sequence[str], base: str, override: str) -> list[Column]:
    """As :func:`merge_config` for two struct columns with the given fields."""
    return [F.coalesce(F.col(override)[f], F.col(base)[f]).alias(f) for f in fields]


# --- seeds ----------------------------------------------------------------------------------------


def _known(metric: str) -> Column:
    return F.nanvl(F.col(metric).cast("double"), F.lit(None).cast("double"))


def seed_summary(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each metric over the runs of a group.

    NaN is left out; if a metric is NaN in every run, so are its mean and deviation.
    """
    nan = F.lit(float("nan"))

    def summary(metric: str, aggregate: Column, suffix: str) -> Column:
        # NULL when no run has the metric, NaN when all runs have NaN
        empty = F.when(F.count(metric) > 0, nan)
        return F.coalesce(aggregate, empty).alias(f"{metric}_{suffix}")

    columns = []
    for metric in metrics:
        columns.append(summary(metric, F.avg(_known(metric)), "mean"))
        columns.append(summary(metric, F.stddev_pop(_known(metric)), "std"))
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_seeds"), *columns)


def position_of(value: Column, order: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in order]), value)


def first_best(
    df: DataFrame, keys: Sequence[str], choice: str, score: Column, position: Column
) -> DataFrame:
    """The choice with the highest score per group; the earliest position wins a tie.

    Scores are compared at twelve digits: means of equal values may differ in the last bit when
    they are added in a different order, and must still count as a tie.
    """
    rank = F.struct(F.round(score, 12).alias("score"), (-position).alias("position"))
    return df.groupBy(*keys).agg(F.max_by(choice, rank).alias(choice), F.max(score).alias("score"))


def select_method(
    runs: DataFrame, keys: Sequence[str], methods: Sequence[str], metric: str = "macro_f1"
) -> DataFrame:
    """Best aggregation method of an experiment by its mean score over seeds."""
    means = runs.groupBy(*keys, "method").agg(F.avg(metric).alias("_mean"))
    return first_best(
        means, keys, "method", F.col("_mean"), position_of(F.col("method"), methods)
    ).withColumnRenamed("method", "selected_aggregation")


def select_candidate(
    summaries: DataFrame,
    keys: Sequence[str],
    score: str = "macro_f1_mean",
    candidate: str = "candidate",
    position: str = "position",
) -> DataFrame:
    """Best candidate of a stage; the first listed wins a tie."""
    return first_best(summaries, keys, candidate, F.col(score), F.col(position))


# --- reports --------------------------------------------------------------------------------------

LEADERBOARD_ORDER = ("stage", "dataset", "modality")


def leaderboard(rows: DataFrame) -> DataFrame:
    """All experiments by stage, dataset and modality, the best on the dev fold first."""
    return rows.orderBy(
        *LEADERBOARD_ORDER, F.col("dev_macro_f1_mean").desc_nulls_last(), "track", "candidate"
    )


def leaderboard_rows(summaries: DataFrame) -> DataFrame:
    """Stored run summaries flattened into leaderboard rows."""
    return summaries.select(
        F.col("stage_name").alias("stage"),
        F.col("suite_track").alias("track"),
        "dataset",
        "modality",
        F.col("candidate_name").alias("candidate"),
        "selected_aggregation",
        *[
            F.col(f"{fold}_metrics_{part}.macro_f1").alias(f"{fold}_macro_f1_{part}")
            for fold in ("dev", "test")
            for part in ("mean", "std")
        ],
        "summary_path",
    )


def final_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("dataset", F.col("test_macro_f1_mean").desc_nulls_last(), "track")


def modality_ranking(rows: DataFrame) -> DataFrame:
    """Rank of each final row inside its dataset by test score."""
    order = Window.partitionBy("dataset").orderBy(
        F.col("test_macro_f1_mean").desc_nulls_last(), "track"
    )
    return rows.withColumn("rank", F.row_number().over(order))


def normalisation_sources(rows: DataFrame) -> DataFrame:
    """Distinct normalisation sources among the final rows of each dataset."""
    return rows.groupBy("dataset").agg(
        F.array_join(F.array_sort(F.collect_set("normalization_source")), ", ").alias("sources")
    )


def experiment_summary(
    runs: DataFrame, keys: Sequence[str], metrics: Sequence[str], best: DataFrame
) -> DataFrame:
    """One record per experiment: metrics of the selected method over seeds, and the seeds' own.

    The list of seeds holds one entry per seed of an experiment.
    """
    chosen = runs.join(best.drop("score"), list(keys)).where(
        F.col("method") == F.col("selected_aggregation")
    )
    grouped = [*keys, "selected_aggregation"]
    per_seed = F.sort_array(F.collect_list(F.struct("seed", *metrics))).alias("seeds")
    return seed_summary(chosen, grouped, metrics).join(
        chosen.groupBy(*grouped).agg(per_seed), grouped
    )


# --- training history -----------------------------------------------------------------------------


def best_epoch(
    history: DataFrame,
    keys: Sequence[str],
    patience: int,
    score: str = "dev_macro_f1",
    epoch: str = "epoch",
) -> DataFrame:
    """``best_epoch, best_score, stopped_epoch``: early stopping read off a training history.

    An epoch is a gain only if it beats all before it; training stops after ``patience`` epochs
    without one. Later epochs of the history are ignored. A run has at most a few hundred epochs.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy(epoch)
    earlier = F.max(score).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gains = history.withColumn("_gain", F.coalesce(F.col(score) > earlier, F.lit(True)))
    gain_number = F.sum(F.col("_gain").cast("int")).over(order)
    since = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(epoch)) - 1
    counted = gains.withColumn("_run", gain_number).withColumn("_misses", since)
    stops = (F.col("_misses") >= patience).cast("int")
    stopped_before = F.coalesce(
        F.sum(stops).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    seen = counted.withColumn("_done", stopped_before).where(F.col("_done") == 0)
    return seen.groupBy(*keys).agg(
        F.max(F.when(F.col("_gain"), F.col(epoch))).alias("best_epoch"),
        F.max(score).alias("best_score"),
        F.max(epoch).alias("stopped_epoch"),
    )


def epoch_loss(batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of batch losses weighted by batch size."""
    items = F.greatest(F.sum("items"), F.lit(1))
    return batches.groupBy(*keys).agg((F.sum(F.col("loss") * F.col("items")) / items).alias("train_loss"))
