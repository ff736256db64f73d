"""Connected components of a link table by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import stored

MAX_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over rows (a, b) with a > b: neighbours are hung on the least of them."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of ``links`` (a, b; integers).

    Large-star and small-star steps in turn, each written to the shared folder, until a round
    changes nothing. The number of rounds grows with the logarithm of the links, and a hub's links meet
    their minimum in a partial aggregate and a join that adaptive execution can split. Links to
    oneself, repeated links, and null ends are ignored; without links the result is empty.
    """
    current = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    mark = _mark(current)
    for _ in range(MAX_ROUNDS):
        if mark[0] == 0:
            break
        current = stored(_star(_star(current, large=True), large=False), "links")
        before, mark = mark, _mark(current)
        if mark == before:
            break
    else:
        raise RuntimeError(f"Components did not settle in {MAX_ROUNDS} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _mark(links: DataFrame) -> tuple[int, int, int]:
    """A fingerprint of the set of links: their number and two sums of hashes."""
    row = links.agg(
        F.count("*").alias("n"),
        F.sum(F.shiftright(F.xxhash64("a", "b"), 16)).alias("x"),
        F.sum(F.shiftright(F.xxhash64("b", "a"), 17)).alias("y"),
    ).first()
    return row["n"], row["x"], row["y"]
