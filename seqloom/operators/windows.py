"""Sliding windows over sparse sequences.

Regular windows start at 0, S, 2S, ... while they fit; if the last one does not reach the end, one
more window is anchored at the end. A sequence no longer than the window gives a single short
window. Bins find their windows by arithmetic on ``sec``, so no range join is needed and each bin
is repeated about W / S times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.vectors import any_nonzero, zeros
from seqloom.operators.sequence import KEYS
from seqloom.operators.skew import expand_range, join_spread

INDEX_BLOCK = 4096


def regular_windows(length: Column, size: int, stride: int) -> Column:
    """Number of windows on the stride grid (one for a short sequence)."""
    return F.when(length <= size, F.lit(1).cast("long")).otherwise(
        F.floor((length - size) / stride) + 1
    )


def has_tail(length: Column, size: int, stride: int) -> Column:
    return (length > size) & ((length - size) % stride != 0)


def window_count(length: Column, size: int, stride: int) -> Column:
    return regular_windows(length, size, stride) + has_tail(length, size, stride).cast("long")


def _start_of(index: Column, length: Column, size: int, stride: int) -> Column:
    return F.least(index * stride, F.greatest(length - size, F.lit(0)))


def window_index(
    lengths: DataFrame, size: int, stride: int, keys: Sequence[str] = KEYS, tail: bool = True
) -> DataFrame:
    """All windows of each sequence: ``keys, window_idx, start, win_len``.

    ``lengths`` has one row per sequence with its length in ``len``.
    """
    length = F.col("len").cast("long")
    count = (window_count if tail else regular_windows)(length, size, stride)
    return expand_range(lengths, count, "window_idx", keys).select(
        *keys,
        "window_idx",
        _start_of(F.col("window_idx"), length, size, stride).alias("start"),
        F.least(length, F.lit(size)).cast("long").alias("win_len"),
    )


def _window_starts_of_bin(sec: Column, length: Column, size: int, stride: int) -> Column:
    """Starts of all windows that contain ``sec``; at most W / S + 2 of them."""
    last = regular_windows(length, size, stride) - 1
    low = F.greatest(F.lit(0), F.ceil((sec - size + 1) / stride)).cast("long")
    high = F.least(F.floor(sec / stride), last).cast("long")
    none = F.array().cast("array<bigint>")
    regular = F.when(
        low <= high, F.transform(F.sequence(low, high, F.lit(1).cast("long")), lambda k: k * stride)
    ).otherwise(none)
    tail_start = (length - size).cast("long")
    tail = F.when(
        has_tail(length, size, stride) & (sec >= tail_start), F.array(tail_start)
    ).otherwise(none)
    return F.when(length <= size, F.array(F.lit(0).cast("long"))).otherwise(
        F.concat(regular, tail)
    )


def _bins_of(seq: DataFrame, keys: Sequence[str], names: Sequence[str] = ()) -> DataFrame:
    return seq.select(*keys, "sec", *names, *[c for c in ("len",) if c in seq.columns])


def assign_windows(
    seq: DataFrame,
    lengths: DataFrame,
    size: int,
    stride: int,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Each bin once per window it belongs to: adds ``start, offset, win_len``.

    Bins that carry the length of their sequence in ``len`` are not joined with ``lengths``.
    """
    length = F.col("len").cast("long")
    sized = seq if "len" in seq.columns else join_spread(seq, lengths.select(*keys, "len"), keys, "sec")
    return (
        sized.withColumn(
            "start",
            F.explode(_window_starts_of_bin(F.col("sec").cast("long"), length, size, stride)),
        )
        .withColumn("offset", (F.col("sec") - F.col("start")).cast("int"))
        .withColumn("win_len", F.least(length, F.lit(size)).cast("long"))
        .drop("len")
    )


def valid_ratio(
    seq: DataFrame,
    lengths: DataFrame,
    size: int,
    stride: int,
    min_ratio: float = 0.5,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Windows whose share of valid bins reaches ``min_ratio``: ``keys, start, win_len, valid_ratio``.

    Only valid bins travel; gaps count as invalid because the divisor is the window length.
    """
    counted = (
        assign_windows(_bins_of(seq.where("valid"), keys), lengths, size, stride, keys)
        .groupBy(*keys, "start")
        .agg(F.count(F.lit(1)).alias("_valid"), F.min("win_len").alias("win_len"))
        .withColumn("valid_ratio", F.col("_valid") / F.col("win_len"))
        .drop("_valid")
    )
    if min_ratio > 0:
        return counted.where(F.col("valid_ratio") >= min_ratio)
    # windows without a single valid bin count as well
    return (
        window_index(lengths, size, stride, keys)
        .drop("window_idx")
        .join(counted.drop("win_len"), [*keys, "start"], "left")
        .withColumn("valid_ratio", F.coalesce(F.col("valid_ratio"), F.lit(0.0)))
    )


def number_windows(windows: DataFrame, stride: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Running ``window_idx`` of the windows that were kept, by start.

    Counted in blocks of starts: a block holds a bounded number of windows and gets its offset from
    the counts of earlier blocks, so a very long sequence is spread over many tasks.
    """
    keys = list(keys)
    blocked = windows.withColumn("_block", F.floor(F.col("start") / (stride * INDEX_BLOCK)))
    earlier = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        blocked.groupBy(*keys, "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy("start")
    return (
        blocked.withColumn("_row", F.row_number().over(inside))
        .join(offsets, [*keys, "_block"])
        .withColumn("window_idx", F.col("_row") - 1 + F.col("_offset"))
        .drop("_row", "_block", "_offset")
    )


def to_matrix(
    windows: DataFrame,
    seq: DataFrame,
    lengths: DataFrame,
    size: int,
    stride: int,
    widths: dict[str, int],
    *,
    keys: Sequence[str] = KEYS,
    gap_rows: dict[str, Column] | None = None,
    pad: bool = True,
) -> DataFrame:
    """One row per window with its bins in order, one matrix column per feature column.

    ``widths`` names the feature columns and their widths. A bin without frames becomes a row of
    zeros, or the array ``gap_rows[name]`` (after normalising, that is the normalised zero vector):
    a literal, or a column of ``windows``. With ``pad``, rows of zeros fill short windows up to ``size``.
    A window collects at most ``size`` bins, whatever the length of its sequence.
    """
    gap_rows = gap_rows or {}
    names = list(widths)
    placed = assign_windows(_bins_of(seq, keys, names), lengths, size, stride, keys)
    bins = placed.groupBy(*keys, "start").agg(
        F.map_from_entries(F.collect_list(F.struct("offset", F.struct(*names)))).alias("_bins")
    )

    def matrix(name: str) -> Column:
        empty = zeros(widths[name])
        missing = gap_rows.get(name, empty)
        rows = F.transform(
            F.sequence(F.lit(0), F.col("win_len").cast("int") - 1),
            lambda i: F.coalesce(F.try_element_at(F.col("_bins"), i)[name], missing),
        )
        if not pad:
            return rows
        return F.concat(rows, F.array_repeat(empty, (F.lit(size) - F.col("win_len")).cast("int")))

    return (
        windows.join(bins, [*keys, "start"], "left")
        .withColumns({name: matrix(name) for name in names})
        .drop("_bins")
    )


def pad_mask(matrix: Column) -> Column:
    """True for rows with any non-zero entry."""
    return F.transform(matrix, any_nonzero)
