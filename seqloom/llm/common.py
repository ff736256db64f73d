"""Text rules and small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the text contracts: space and U+0009 to U+000D. ``bytes.split()`` splits at the same.
SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged. Plain ASCII takes the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def words(text: Column) -> Column:
    """The words of a text, in order, as an array. Splitting at one plain character is the fast case."""
    return F.array_remove(F.split(F.regexp_replace(text, "[\\x09-\\x0D]+", " "), " "), "")


def signed(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Spark's signed longs, bit for bit."""
    return pa.array(values.view(np.int64))


def free_name(df: DataFrame, base: str) -> str:
    """A column name like ``base`` that ``df`` has not, upper and lower case being the same."""
    taken, name, n = {c.lower() for c in df.columns}, base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def slices(texts: pa.Array, limit: int = 4_000_000) -> Iterator[list[bytes]]:
    """Consecutive texts as UTF-8 (null: empty), at least one and about ``limit`` bytes at a time.

    Keeps the arrays made from them bounded however many rows an Arrow batch holds.
    """
    held, size = [], 0
    for value in texts.cast(pa.large_binary()):
        data = value.as_py() or b""
        if held and size + len(data) > limit:
            yield held
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield held
