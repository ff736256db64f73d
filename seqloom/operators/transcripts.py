"""Audit of conversations before any text is used: how short, how scrubbed, how uneven."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.quantile import robust_centre

#: Utterances of fewer words are short.
SHORT_BELOW = 5
#: Deviations, in units of the scaled median absolute deviation, beyond which a session is odd.
ODD_BEYOND = 3.0
#: Fixed value: scales the median absolute deviation to the deviation of a normal distribution.
NORMAL_SCALE = 1.4826


def turn_facts(turns: DataFrame, text: str = "text", short_below: int = SHORT_BELOW) -> DataFrame:
    """``tokens, short, scrubbed, question`` for each turn; a turn without a word is scrubbed."""
    words = F.size(F.array_remove(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "), " "), ""))
    return turns.withColumn("tokens", words.cast("long")).withColumns(
        {
            "scrubbed": (F.col("tokens") == 0).cast("long"),
            "short": ((F.col("tokens") > 0) & (F.col("tokens") < short_below)).cast("long"),
            "question": F.coalesce(F.rtrim(F.col(text)).endswith("?"), F.lit(False)).cast("long"),
        }
    )


def session_facts(turns: DataFrame, session: str = "conv_id", by: Sequence[str] = ("role",), **options) -> DataFrame:
    """Turns, tokens and flagged turns per session and group, combined before the shuffle."""
    facts = turn_facts(turns, **options)
    return facts.groupBy(*by, session).agg(
        F.count(F.lit(1)).alias("turns"), *[F.sum(c).alias(c) for c in ("tokens", "short", "scrubbed", "question")]
    )


def transcript_audit(
    turns: DataFrame,
    session: str = "conv_id",
    by: Sequence[str] = ("role",),
    odd_beyond: float = ODD_BEYOND,
    **options,
) -> DataFrame:
    """One row per group: sessions, turns, shares of short, scrubbed and question turns, tokens a session.

    A session is odd if its tokens differ from the group's median by more than ``odd_beyond`` scaled
    median absolute deviations; with a deviation of zero, any other number of tokens is odd. Medians
    are exact and are found by running counts, so a group may be of any size.
    """
    sessions = session_facts(turns, session, by, **options)
    centre = robust_centre(sessions, "tokens", by)
    away = F.abs(F.col("tokens") - F.col("median"))
    marked = sessions.join(centre, list(by)).withColumn(
        "_odd", (away > F.lit(odd_beyond * NORMAL_SCALE) * F.col("mad")).cast("long")
    )
    total = marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sessions"),
        *[F.sum(c).alias(c) for c in ("turns", "tokens", "short", "scrubbed", "question")],
        F.max("median").alias("median_tokens"),
        F.max("mad").alias("mad_tokens"),
        F.sum("_odd").alias("odd_sessions"),
    )
    share = {f"{c}_share": F.col(c) / F.col("turns") for c in ("short", "scrubbed", "question")}
    return total.withColumns(
        {**share, "mean_tokens": F.col("tokens") / F.col("sessions"), "odd_share": F.col("odd_sessions") / F.col("sessions")}
    ).drop("short", "scrubbed", "question")
