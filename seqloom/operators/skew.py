"""Joins, expansions and running sums that stay bounded per task when one key dominates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seqloom.session import checkpointed

SPREAD_PARTS = 32
# rows of one key that a task may well join alone
SPREAD_BLOCK = 65_536
EXPAND_BLOCK = 4096
# a sort of this many short rows is light work for one task
ONE_TASK_ROWS = 1_000_000


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` in which a NULL key meets a NULL key."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, same).drop(*[f"_right_{k}" for k in keys])


def join_spread(
    rows: DataFrame,
    per_key: DataFrame,
    on: Sequence[str],
    spread: str,
    how: str = "inner",
    parts: int = SPREAD_PARTS,
    last: Column | None = None,
) -> DataFrame:
    """Join many rows per key with one row per key, splitting each key over ``parts`` tasks.

    ``spread`` is an integer column of ``rows`` that varies inside a key (a time bin, say). The
    one-row side is repeated ``parts`` times. Because the exchange is on (key, part), a later
    grouping on (key, bin) shuffles afresh instead of inheriting a placement by key alone. A small
    ``per_key`` is still broadcast by Spark under its own size limit.

    Where a column ``last`` of ``per_key`` says up to which value of ``spread`` (from 0 on) its rows are
    asked for, keys are split in blocks of ``SPREAD_BLOCK`` values and only as many copies are made
    as the key has blocks: one for each short key. Rows beyond ``last`` may or may not meet it.
    """
    on = list(on)
    if last is None:
        part, most = F.col(spread), F.lit(parts - 1)
    else:
        part = F.floor(F.col(spread) / SPREAD_BLOCK)
        most = F.least(F.floor(last / SPREAD_BLOCK), F.lit(parts - 1)).cast("int")
    salted = rows.withColumn("_part", F.pmod(part, F.lit(parts)).cast("int"))
    copies = per_key.withColumn("_part", F.explode(F.sequence(F.lit(0), most)))
    return salted.join(copies, on + ["_part"], how).drop("_part")


def work_partitions(df: DataFrame) -> int:
    """Partitions for rows that are small themselves but stand for much work.

    An explicit number is not coalesced by adaptive execution, which would judge such rows by their
    bytes and give the work of all of them to a few tasks.
    """
    spark = df.sparkSession
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism,
    )


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Compute ``df`` once, count it, and mark it for broadcast only within ``max_rows`` rows.

    Beyond that it stays an ordinary side of a shuffled join.
    """
    stored = checkpointed(df)
    return F.broadcast(stored) if stored.limit(max_rows + 1).count() <= max_rows else stored


def expand_range(
    df: DataFrame, count: Column, out: str, keys: Sequence[str], block: int = EXPAND_BLOCK
) -> DataFrame:
    """One output row per integer 0 .. count-1.

    Expansion runs in two steps with a shuffle of the (few) blocks between, so that one row with
    a huge count is worked on by many tasks and no array exceeds ``block`` entries.
    """
    blocks = (
        df.withColumn("_count", count.cast("long"))
        .where(F.col("_count") > 0)
        .withColumn(
            "_block",
            F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_count") - 1) / block))),
        )
        .repartition(work_partitions(df), *keys, "_block")
    )
    first = F.col("_block") * block
    last = F.least(first + block, F.col("_count")) - 1
    return blocks.withColumn(out, F.explode(F.sequence(first, last))).drop("_count", "_block")


def ordered_prefix(
    points: DataFrame,
    by: Sequence[str],
    order: Column,
    sums: Sequence[str],
    lead: Sequence[str] = (),
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Running sums over an order inside each group, with no group too large for a task.

    ``points`` has one row per (group, value): aggregate ties beforehand. The table is stored and its
    groups are counted. If none has more than ``one_task_rows`` rows, a window per group is enough. Else
    rows are range-partitioned on (group, value), so any group, however large, is cut into even
    blocks; block totals are one row per block, and their running sum gives each block its offset.
    The blocks are checkpointed because rows and totals must see the same cut.

    Adds ``before_<s>`` (sum over earlier rows) and ``total_<s>`` (sum over the group) for each of
    ``sums`` and ``next_<c>`` (value in the following row, NULL at the end) for each of ``lead``.
    """
    keys = list(by) or ["_all"]
    base = points if by else points.withColumn("_all", F.lit(0))
    stored = checkpointed(base.withColumn("_order", order))
    small = stored.limit(one_task_rows + 1).count() <= one_task_rows or (
        stored.groupBy(*keys).count().where(F.col("count") > one_task_rows).isEmpty()
    )
    ranked = (_prefix_in_groups if small else _prefix_in_blocks)(stored, keys, sums, lead)
    return ranked.select(
        *points.columns,
        *[f"before_{s}" for s in sums],
        *[f"total_{s}" for s in sums],
        *[f"next_{c}" for c in lead],
    )


def _earlier_sum(column: str, order: WindowSpec) -> Column:
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(earlier), F.lit(0))


def _prefix_in_groups(
    stored: DataFrame, keys: Sequence[str], sums: Sequence[str], lead: Sequence[str]
) -> DataFrame:
    group = Window.partitionBy(*keys)
    order = group.orderBy("_order")
    return stored.select(
        "*",
        *[_earlier_sum(s, order).alias(f"before_{s}") for s in sums],
        *[F.sum(s).over(group).alias(f"total_{s}") for s in sums],
        *[F.lead(c).over(order).alias(f"next_{c}") for c in lead],
    )


def _prefix_in_blocks(
    stored: DataFrame, keys: Sequence[str], sums: Sequence[str], lead: Sequence[str]
) -> DataFrame:
    blocks = checkpointed(
        stored.repartitionByRange(*[F.col(k) for k in keys], F.col("_order").asc()).withColumn(
            "_block", F.spark_partition_id()
        )
    )
    totals = blocks.groupBy(*keys, "_block").agg(
        *[F.sum(s).alias(f"_sum_{s}") for s in sums],
        *[F.min_by(c, "_order").alias(f"_first_{c}") for c in lead],
    )
    group = Window.partitionBy(*keys)
    across = group.orderBy("_block")
    offsets = totals.select(
        *keys,
        "_block",
        *[_earlier_sum(f"_sum_{s}", across).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_sum_{s}").over(group).alias(f"total_{s}") for s in sums],
        *[F.lead(f"_first_{c}").over(across).alias(f"_after_{c}") for c in lead],
    )
    inside = Window.partitionBy(*keys, "_block").orderBy("_order")
    running = blocks.select(
        "*",
        *[_earlier_sum(s, inside).alias(f"_in_{s}") for s in sums],
        *[F.lead(c).over(inside).alias(f"_in_next_{c}") for c in lead],
    )
    return join_null_safe(running, offsets, [*keys, "_block"]).withColumns(
        {
            **{f"before_{s}": F.col(f"_in_{s}") + F.col(f"_off_{s}") for s in sums},
            **{f"next_{c}": F.coalesce(f"_in_next_{c}", f"_after_{c}") for c in lead},
        }
    )
