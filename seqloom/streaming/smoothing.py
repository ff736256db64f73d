"""Smoothed risk state of each subject from a stream of window predictions.

The state of a subject is an exponential average of its probabilities, how many windows in a row gave
evidence, and whether risk is shown. Risk is raised and lowered only after it has persisted, and
nothing is shown before there is enough evidence in a row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "subject_id string, micros long, probability double, ema double, evidence int, state string"
INSUFFICIENT, NORMAL, ELEVATED = "insufficient", "normal", "elevated"


@dataclass(frozen=True)
class Smoothing:
    """``alpha``: weight of the newest probability. ``evidence``: valid windows in a row before anything is
    shown. Risk is raised (lowered) when the average was at least ``up`` (at most ``down``) in ``persist``
    windows in a row. After a gap of more than ``timeout_seconds`` a subject starts anew."""

    alpha: float = 0.3
    evidence: int = 3
    up: float = 0.6
    down: float = 0.4
    persist: int = 2
    timeout_seconds: int = 7 * 86_400


@dataclass
class Track:
    """What is carried from one window of a subject to the next."""

    ema: float | None = None
    evidence: int = 0
    above: int = 0
    below: int = 0
    elevated: bool = False
    last: int | None = None

    def step(self, micros: int, probability: float | None, rule: Smoothing) -> tuple[float | None, int, str]:
        """Take one window in; a probability of None is a window without evidence."""
        if self.last is not None and micros - self.last > rule.timeout_seconds * 1_000_000:
            self.__init__()
        self.last = micros
        if probability is None:
            self.evidence = self.above = self.below = 0
        else:
            old = self.ema
            self.ema = probability if old is None else rule.alpha * probability + (1.0 - rule.alpha) * old
            self.evidence += 1
            self.above = self.above + 1 if self.ema >= rule.up else 0
            self.below = self.below + 1 if self.ema <= rule.down else 0
        if self.elevated:
            self.elevated = self.below < rule.persist
        else:
            self.elevated = self.above >= rule.persist and self.evidence >= rule.evidence
        shown = ELEVATED if self.elevated else NORMAL
        return self.ema, self.evidence, shown if self.evidence >= rule.evidence else INSUFFICIENT


def smoothed(
    windows: DataFrame,
    subject: Column,
    ts: str,
    probability: Column,
    valid: Column,
    rule: Smoothing = Smoothing(),
    delay: str = "1 hour",
) -> DataFrame:
    """One row for every window whose time the watermark has reached: ``subject_id, micros, probability, ema,
    evidence, state``.

    Windows wait in the state until the watermark (latest time less ``delay``) reaches them and are then
    taken in the order of their times, so the result does not depend on how the input was cut into
    micro-batches; later ones are late and dropped. The state holds a subject's windows of one delay and
    one micro-batch, and is removed when the subject has been silent for the time-out. A window that is
    not valid, or has no probability, counts as one without evidence. Subjects without an id are one
    subject; windows without a time are left out.
    """
    rows = windows.select(
        F.coalesce(subject.cast("string"), F.lit("")).alias("subject_id"),
        ts,
        F.unix_micros(ts).alias("micros"),
        probability.cast("double").alias("probability"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
    ).where(F.col(ts).isNotNull())

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carried = json.loads(state.get[0]) if state.exists else {"track": {}, "waiting": []}
        track, waiting = Track(**carried["track"]), [tuple(w) for w in carried["waiting"]]
        for batch in batches:
            for at, p, ok in zip(batch["micros"], batch["probability"], batch["valid"]):
                waiting.append((int(at), bool(ok), None if pd.isna(p) else float(p)))
        reached = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda w: (w[0], w[1], w[2] is not None, w[2] or 0.0))
        out = []
        while waiting and waiting[0][0] <= reached:
            at, ok, p = waiting.pop(0)
            out.append((key[0], at, p, *track.step(at, p if ok else None, rule)))
        quiet_from = None if track.last is None else track.last // 1000 + rule.timeout_seconds * 1000 + 1
        if not waiting and quiet_from is not None and quiet_from <= reached // 1000:
            state.remove()
        else:
            state.update((json.dumps({"track": vars(track), "waiting": waiting}),))
            wake = waiting[0][0] // 1000 if waiting else quiet_from
            state.setTimeoutTimestamp(max(wake, reached // 1000 + 1))
        names = [c.split()[0] for c in OUTPUT.split(", ")]
        if out:
            yield pd.DataFrame(out, columns=names).astype({"probability": "float64", "ema": "float64"})

    return (
        rows.withWatermark(ts, delay)
        .groupBy("subject_id")
        .applyInPandasWithState(advance, OUTPUT, "carried string", "append", GroupStateTimeout.EventTimeTimeout)
    )
