"""Intervals, slices, abstaining, quantiles and transcripts against plain implementations."""

from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import bootstrap, metrics, quantile, selective, transcripts

SCHEMA = "subject_id string, grp string, label int, num_windows long, probability double, prediction int"


def subjects(spark, n=300, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p = round(rng.random(), 2)
        rows.append((str(i), rng.choice(["a", "b", None]), int(rng.random() < p), 3, p, int(p >= 0.5)))
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_copies_are_poisson_and_independent(spark):
    rows = spark.range(400).select((F.col("id") * 9_999_991 % 2**32).alias("h"), (F.col("id") * 77_003 % 2**32).alias("l"))
    pairs = rows.select("h", "l", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(250).cast("long"))).alias("r"))
    drawn = bootstrap.with_copies(pairs, "h", "l", "r", "n").groupBy("n").count().collect()
    total = sum(r["count"] for r in drawn)
    share = {r["n"]: r["count"] / total for r in drawn}
    for k in range(5):
        assert share[k] == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.006)
    wide = bootstrap.with_copies(pairs, "h", "l", "r", "n").groupBy("h").pivot("r", [1, 2, 3]).agg(F.first("n")).toPandas()
    assert np.abs(np.corrcoef(wide[["1", "2", "3"]].T.values.astype(float)) - np.eye(3)).max() < 0.2


def test_intervals_hold_the_estimate(spark):
    rows, df = subjects(spark)
    found = {r["metric"]: r for r in bootstrap.bootstrap_intervals(df, replicates=300).collect()}
    record = metrics.classification_metrics(df).first()
    for name in ("precision", "recall", "macro_f1", "weighted_f1", "brier_score", "ece"):
        assert found[name]["estimate"] == pytest.approx(record[name], abs=1e-12)
    right = [int(y == z) for _, _, y, _, _, z in rows]
    assert found["accuracy"]["estimate"] == pytest.approx(sum(right) / len(right))
    error = statistics.pstdev(right) / math.sqrt(len(right))
    assert found["accuracy"]["std"] == pytest.approx(error, rel=0.25)
    assert found["accuracy"]["low"] == pytest.approx(found["accuracy"]["estimate"] - 1.96 * error, abs=0.015)
    assert all(r["low"] <= r["high"] and r["replicates"] == 300 for r in found.values())
    again = {r["metric"]: r for r in bootstrap.bootstrap_intervals(df.repartition(5), replicates=300).collect()}
    for name in ("estimate", "low", "high"):  # made of whole numbers: free of the order of addition
        assert again["accuracy"][name] == found["accuracy"][name]
    with pytest.raises(ValueError, match="No intervals"):
        bootstrap.bootstrap_intervals(df, metrics=["auroc"])


def test_groups_and_empty_input(spark):
    _, df = subjects(spark)
    by_group = bootstrap.bootstrap_intervals(df, ["grp"], replicates=20, metrics=["accuracy"]).collect()
    assert {r["grp"] for r in by_group} == {"a", "b", None}
    assert bootstrap.bootstrap_intervals(df.limit(0), ["grp"], replicates=5).count() == 0


def test_slices_are_the_records_of_their_subjects(spark):
    _, df = subjects(spark)
    slices = {"all": F.lit("x"), "grp": F.col("grp"), "side": F.col("probability") < 0.3}
    found = {(r["slice"], r["value"]): r for r in metrics.slice_metrics(df, slices).collect()}
    assert len(found) == 6
    for key, rows in {("all", "x"): df, ("grp", None): df.where("grp IS NULL"), ("side", "true"): df.where("probability < 0.3")}.items():
        alone = metrics.classification_metrics(rows).first().asDict()
        for name, value in alone.items():
            assert found[key][name] == pytest.approx(value, nan_ok=True), (key, name)


def test_calibration_record_holds_bins_and_totals(spark):
    _, df = subjects(spark)
    record = metrics.calibration_record(df).first()
    whole = metrics.classification_metrics(df).first()
    assert (record["num_subjects"], record["ece"]) == (300, pytest.approx(whole["ece"]))
    bins = metrics.calibration_bins(df).orderBy("bin_index").collect()
    assert [b["count"] for b in record["bins"]] == [b["count"] for b in bins]


def test_risk_and_coverage_keep_ties_together(spark):
    rows, df = subjects(spark)
    curve = {r["threshold"]: r for r in selective.risk_coverage(df).collect()}
    confidence = [max(r[4], 1.0 - r[4]) for r in rows]
    assert set(curve) == set(confidence)
    for t, r in curve.items():
        taken = [x for x, c in zip(rows, confidence) if c >= t]
        assert r["covered"] == len(taken) and r["coverage"] == pytest.approx(len(taken) / 300)
        assert r["risk"] == pytest.approx(sum(x[2] != x[5] for x in taken) / len(taken))
    area = sum(curve[c]["risk"] for c in confidence) / 300
    summary = {r["target"]: r for r in selective.selective_summary(df, targets=(0.0, 0.2, 1.0)).collect()}
    assert all(r["aurc"] == pytest.approx(area) for r in summary.values())
    assert summary[1.0]["coverage"] == 1.0 and summary[1.0]["threshold"] == min(confidence)
    fit = [t for t, r in curve.items() if r["risk"] <= 0.2]
    assert summary[0.2]["threshold"] == min(fit) and summary[0.2]["coverage"] == max(curve[t]["coverage"] for t in fit)
    none = [t for t, r in curve.items() if r["risk"] <= 0.0]
    assert summary[0.0]["threshold"] == (min(none) if none else None)


@pytest.mark.parametrize("one_task_rows", [3, 10**6])
def test_exact_quantiles(spark, one_task_rows):
    rng = random.Random(1)
    values = {"a": [rng.choice([rng.random(), 0.5, -2.0]) for _ in range(201)], "b": [1.5], "c": [2.0, 4.0], None: [7.0, 7.0, 1.0]}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("d", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    names = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.9, "high": 1.0}
    got = {r["g"]: r for r in quantile.exact_quantiles(df, "v", names, ["g"], one_task_rows).collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        assert got[g]["count"] == len(vs)
        for name, q in names.items():
            assert got[g][name] == pytest.approx(np.quantile(vs, q)), (g, name)


def test_transcripts(spark):
    texts = {1: ["hello there my old friend", "yes", "", None], 2: ["one two three four five six"] * 2, 3: ["word " * 500]}
    rows = [(c, n, "user", t) for c, ts in texts.items() for n, t in enumerate(ts)] + [(9, 0, "assistant", "why ? ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["role"]: r for r in transcripts.transcript_audit(df).collect()}
    user = got["user"]
    assert (user["sessions"], user["turns"], user["tokens"]) == (3, 7, 518)
    assert (user["median_tokens"], user["mad_tokens"], user["odd_sessions"]) == (12.0, 6.0, 1)
    assert user["short_share"] == pytest.approx(1 / 7) and user["scrubbed_share"] == pytest.approx(2 / 7)
    assert got["assistant"]["question_share"] == 1.0 and got["assistant"]["odd_sessions"] == 0
    assert transcripts.transcript_audit(df.limit(0)).count() == 0
