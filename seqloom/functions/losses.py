"""Window losses as column expressions, picked by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def bce_with_logits(logit: Column, target: Column, pos_weight: Column | float = 1.0) -> Column:
    """Binary cross-entropy of a logit; positives count ``pos_weight`` times."""
    weight = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    y = target.cast("double")
    # log(1 + exp(-z)) without overflow on either side
    softplus = F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0))
    return (F.lit(1.0) - y) * logit + (F.lit(1.0) + (weight - F.lit(1.0)) * y) * softplus


def focal(logit: Column, target: Column, gamma: float = 2.0, alpha: float = 0.75) -> Column:
    """Cross-entropy scaled down for windows that are already classified well."""
    positive = target > 0.5
    p = sigmoid(logit)
    p_true = F.when(positive, p).otherwise(F.lit(1.0) - p)
    share = F.when(positive, F.lit(alpha)).otherwise(F.lit(1.0 - alpha))
    return share * F.pow(F.lit(1.0) - p_true, F.lit(gamma)) * bce_with_logits(logit, target)


def window_loss(name: str, logit: Column, target: Column, **options) -> Column:
    losses = {"bce": bce_with_logits, "focal": focal}
    if name not in losses:
        raise ValueError(f"No loss is called {name}")
    return losses[name](logit, target, **options)
