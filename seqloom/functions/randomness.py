"""Repeatable uniforms: they depend on the row's key and a seed, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_DIGITS = 13  # 52 bits, exact in a double


def hash_uniform(key: Column, seed: int | Column) -> Column:
    """Uniform in [0, 1) from the MD5 digest of ``key:seed``."""
    seed_text = (seed if isinstance(seed, Column) else F.lit(int(seed))).cast("string")
    digest = F.md5(F.concat_ws(":", key.cast("string"), seed_text))
    whole = F.conv(F.substring(digest, 1, _HEX_DIGITS), 16, 10).cast("double")
    return whole / F.lit(float(16**_HEX_DIGITS))


def whole_copies(rate: Column, uniform: Column) -> Column:
    """How often to repeat a row that is expected ``rate`` times: the whole part, and one more with the
    probability of the rest."""
    return (F.floor(rate) + (uniform < rate - F.floor(rate)).cast("long")).cast("long")
