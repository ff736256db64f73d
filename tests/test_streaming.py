from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from seqloom.streaming import run, smoothing, windows
from seqloom.streaming.ingest import append_new_files

DAY = 86_400


def test_only_new_files_are_processed(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.range(10).withColumnRenamed("id", "k").coalesce(1).write.parquet(landing)

    def work():
        return append_new_files(spark, landing, "k long", out, state, lambda df: df.where("k % 2 = 0"))

    assert work() == 10
    assert work() == 0
    spark.range(10, 14).withColumnRenamed("id", "k").coalesce(1).write.mode("append").parquet(landing)
    assert work() == 4
    got = spark.read.parquet(out).agg(F.sort_array(F.collect_list("k"))).first()[0]
    assert got == [0, 2, 4, 6, 8, 10, 12]


SCHEMA = "subject_id string, at long, p double, ok boolean"


def write(spark, rows, path):
    """One more file of the stream."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    return rows.withColumn("ts", F.timestamp_seconds("at"))


def rows_of(n, seed, subjects="abc"):
    rng = random.Random(seed)
    return [
        (rng.choice(subjects), t * 1800 + rng.randint(0, 900), rng.choice([0.1, 0.5, 0.9, 0.95, None]), rng.random() < 0.9)
        for t in range(n)
    ]


def closed_windows(rows, watermark):
    out = {}
    for s, at, p, _ in rows:
        for i in range(4):
            start = at // 21_600 * 21_600 - i * 21_600
            if start + DAY <= watermark:
                out.setdefault((s, start), []).append(p)
    return {k: len(v) for k, v in out.items()}


def test_windows_late_rows_and_restart(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = rows_of(300, 1)

    def work():
        found = windows.sliding_windows(stream(spark, landing), ["subject_id"], "p")
        return run.append_available(found, out, state)

    def got():
        table = spark.read.parquet(out)
        found = [(r["subject_id"], int(r["start"].timestamp()), r["events"]) for r in table.collect()]
        assert len(found) == len({f[:2] for f in found})  # none twice
        return {f[:2]: f[2] for f in found}

    write(spark, rows[:150], landing)
    assert work().late == 0
    assert got() == closed_windows(rows[:150], rows[149][1] - 3600)
    # A row for windows that are closed counts as late, once for each of them, and changes nothing.
    late = ("a", rows[10][1], 0.5, True)
    write(spark, [late, *rows[150:]], landing)
    totals = work()
    assert (totals.rows, totals.late) == (151, 4)
    assert got() == closed_windows(rows, rows[-1][1] - 3600)
    assert work().rows == 0
    assert got() == closed_windows(rows, rows[-1][1] - 3600)


def sequential(rows, watermark, rule):
    """The rules of the smoothed state, told once more in a loop over a subject's windows."""
    out, subjects = [], {}
    for s, at, p, ok in sorted(rows, key=lambda r: (r[1], r[3], r[2] is not None, r[2] or 0)):
        if at > watermark:
            continue
        history = subjects.setdefault(s, [])
        if history and at - history[-1]["at"] > rule.timeout_seconds:
            history.clear()
        before = history[-1] if history else {"ema": None, "evidence": 0, "up": 0, "down": 0, "risk": False}
        now = {**before, "at": at, "evidence": 0, "up": 0, "down": 0}
        if ok and p is not None:
            now["ema"] = p if before["ema"] is None else rule.alpha * p + (1.0 - rule.alpha) * before["ema"]
            now["evidence"] = before["evidence"] + 1
            now["up"] = before["up"] + 1 if now["ema"] >= rule.up else 0
            now["down"] = before["down"] + 1 if now["ema"] <= rule.down else 0
        if before["risk"] and now["down"] >= rule.persist:
            now["risk"] = False
        if not before["risk"] and now["up"] >= rule.persist and now["evidence"] >= rule.evidence:
            now["risk"] = True
        history.append(now)
        state = "insufficient" if now["evidence"] < rule.evidence else "elevated" if now["risk"] else "normal"
        out.append((s, at * 10**6, p, now["ema"], now["evidence"], state))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cuts", [[400], [1, 60, 200, 230, 400]])
def test_smoothing_does_not_depend_on_micro_batches(spark, tmp_path, cuts):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = rows_of(200, 2) + [("c", r[1] + 40 * DAY, *r[2:]) for r in rows_of(200, 3)]
    rng = random.Random(9)
    rule = smoothing.Smoothing(timeout_seconds=2 * DAY)
    for low, high in zip([0, *cuts], cuts):
        # Inside a file, and by less than the delay across files, the order does not matter.
        part = rows[low:high]
        rng.shuffle(part)
        write(spark, part, landing)
        source = stream(spark, landing)
        found = smoothing.smoothed(source, F.col("subject_id"), "ts", F.col("p"), F.col("ok"), rule, "2 hours")
        assert run.append_available(found, out, state).late == 0
    got = sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=repr)
    want = sequential(rows, max(r[1] for r in rows) - 7200, rule)
    assert len(want) > 380 and {w[5] for w in want} == {"insufficient", "normal", "elevated"}
    assert got == want
