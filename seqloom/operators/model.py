"""Window classifier on pooled features: a distributed stand-in for a learned sequence encoder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.vectors import any_nonzero
from seqloom.operators import sampling

POOLS = ("mean", "std", "min", "max")


def _fold_rows(rows: Column, start: Column, step) -> Column:
    return F.aggregate(rows, start, lambda acc, row: F.zip_with(acc, row, step))


def window_features(matrix: Column, width: int) -> Column:
    """Mean, deviation, minimum and maximum of every dimension over the rows that hold data.

    Rows of zeros (padding) are left out; a window of nothing else gives zeros. A matrix has at most
    one window's rows.
    """

    def constant(value: float) -> Column:
        return F.array_repeat(F.lit(float(value)), width)

    def pooled(rows: Column) -> Column:
        n = F.size(rows).cast("double")
        total = _fold_rows(rows, constant(0), lambda a, x: a + x)
        mean = F.transform(total, lambda s: s / n)
        low = _fold_rows(rows, constant(float("inf")), lambda a, x: F.least(a, x))
        high = _fold_rows(rows, constant(float("-inf")), lambda a, x: F.greatest(a, x))

        def with_mean(m: Column) -> Column:
            squares = F.aggregate(
                rows,
                constant(0),
                lambda acc, row: F.zip_with(
                    acc, F.zip_with(row, m, lambda x, c: (x - c) * (x - c)), lambda a, d: a + d
                ),
            )
            std = F.transform(squares, lambda s: F.sqrt(s / n))
            return F.concat(m, std, low, high)

        # binding the mean keeps it from being computed again for every row
        return F.flatten(F.transform(F.array(mean), with_mean))

    doubles = matrix.cast("array<array<double>>")
    real = F.filter(doubles, any_nonzero)
    return F.flatten(
        F.transform(
            F.array(real),
            lambda rows: F.when(F.size(rows) > 0, pooled(rows)).otherwise(
                F.array_repeat(F.lit(0.0), len(POOLS) * width)
            ),
        )
    )


def fuse(visual: Column, acoustic: Column, gate: Column | float = 0.5) -> Column:
    """Two equally wide window vectors in one: gated sum, distance, product and both gated parts."""
    g = gate if isinstance(gate, Column) else F.lit(float(gate))
    gated_v = F.transform(visual, lambda x: x * g)
    gated_a = F.transform(acoustic, lambda x: x * (F.lit(1.0) - g))
    return F.concat(
        F.zip_with(gated_v, gated_a, lambda v, a: v + a),
        F.zip_with(visual, acoustic, lambda v, a: F.abs(v - a)),
        F.zip_with(visual, acoustic, lambda v, a: v * a),
        gated_v,
        gated_a,
    )


@dataclass(frozen=True)
class TrainConfig:
    """How one classifier is fitted. ``loss_name`` and the two balance switches as in a sweep."""

    loss_name: str = "bce"
    balanced_sampling: bool = True
    use_pos_weight: bool = False
    focal_gamma: float = 2.0
    focal_alpha: float = 0.75
    reg_param: float = 0.01
    max_iter: int = 20


def _estimator(config: TrainConfig, weighted: bool) -> LogisticRegression:
    estimator = LogisticRegression(
        featuresCol="_vector",
        labelCol="label_binary",
        maxIter=config.max_iter,
        regParam=config.reg_param,
        probabilityCol="_probability",
        rawPredictionCol="_raw",
        predictionCol="_predicted",
    )
    return estimator.setWeightCol("_weight") if weighted else estimator


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("_vector", array_to_vector(F.col("features").cast("array<double>")))


def score(model: LogisticRegressionModel, windows: DataFrame) -> DataFrame:
    """Windows with ``window_probability``; no row moves."""
    scored = model.transform(_vectors(windows))
    probability = vector_to_array("_probability")[1].alias("window_probability")
    return scored.select(*windows.columns, probability)


def train(windows: DataFrame, config: TrainConfig, seed: int, key: Column) -> LogisticRegressionModel:
    """Fit on the given windows (``features, label_binary``); ``key`` identifies a window."""
    if config.loss_name not in ("bce", "focal"):
        raise ValueError(f"No loss is called {config.loss_name}")
    rows = windows
    if config.balanced_sampling:
        rows = sampling.weighted_resample(windows, key, seed).drop("copy")
    rows = _vectors(rows)
    weighted = False
    if config.use_pos_weight and config.loss_name == "bce":
        ratio = sampling.pos_weight(windows).select("pos_weight").first()[0]
        weight = F.when(F.col("label_binary") == 1, F.lit(float(ratio))).otherwise(F.lit(1.0))
        rows, weighted = rows.withColumn("_weight", weight), True
    model = _estimator(config, weighted).fit(rows)
    if config.loss_name == "focal":
        # one reweighting step: each window counts by the focal factor under the first fit
        positive = F.col("label_binary") == 1
        p = vector_to_array("_probability")[1]
        p_true = F.when(positive, p).otherwise(F.lit(1.0) - p)
        share = F.when(positive, F.lit(config.focal_alpha)).otherwise(1.0 - config.focal_alpha)
        factor = share * F.pow(F.lit(1.0) - p_true, F.lit(config.focal_gamma))
        scored = model.transform(rows).select("_vector", "label_binary", factor.alias("_weight"))
        model = _estimator(config, True).fit(scored)
    return model


def train_and_score(
    windows: DataFrame,
    config: TrainConfig,
    seed: int,
    *,
    key: Column,
    fold: str = "fold",
    score_folds: tuple[str, ...] = ("dev", "test"),
) -> DataFrame:
    """Fit on the train fold, return the other folds with ``window_probability``."""
    model = train(windows.where(F.col(fold) == "train"), config, seed, key)
    return score(model, windows.where(F.col(fold).isin(*score_folds)))
