from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import aggregate, errors, metrics

SCHEMA = "subject_id string, label int, num_windows long, probability double, prediction int"


def subjects(spark, rows):
    return spark.createDataFrame(
        [(str(i), y, 3, float(p), int(p >= 0.5)) for i, (y, p) in enumerate(rows)], SCHEMA
    )


def from_counts(spark, tn, fp, fn, tp):
    rows = [(0, 0.1)] * tn + [(0, 0.9)] * fp + [(1, 0.1)] * fn + [(1, 0.9)] * tp
    return subjects(spark, rows)


# published confusion matrices and the scores they must give
@pytest.mark.parametrize(
    "counts, expected",
    [
        ((51, 38, 33, 90), (0.6533634249130645, 0.6635903761983368, 0.703125, 0.7317073170731707)),
        ((32, 13, 15, 42), (0.7228260869565217, None, 0.7636363636363637, 0.7368421052631579)),
    ],
)
def test_golden_scores(spark, counts, expected):
    row = metrics.with_scores(metrics.confusion(from_counts(spark, *counts))).first()
    macro, weighted, precision, recall = expected
    assert row["macro_f1"] == pytest.approx(macro, abs=1e-12)
    assert row["precision"] == pytest.approx(precision, abs=1e-12)
    assert row["recall"] == pytest.approx(recall, abs=1e-12)
    if weighted:
        assert row["weighted_f1"] == pytest.approx(weighted, abs=1e-12)


def test_absent_class_is_left_out_of_macro(spark):
    row = metrics.with_scores(metrics.confusion(from_counts(spark, 0, 0, 1, 3))).first()
    # the negative class occurs as a prediction, so it counts with F1 0
    assert row["macro_f1"] == pytest.approx((0 + 6 / 7) / 2)
    row = metrics.with_scores(metrics.confusion(from_counts(spark, 0, 0, 0, 3))).first()
    assert row["macro_f1"] == 1.0 and row["precision"] == 1.0


def brute_auroc(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return wins / (len(pos) * len(neg))


def brute_ap(rows):
    positives = sum(y for y, _ in rows)
    ap, before = 0.0, 0
    for t in sorted({p for _, p in rows}, reverse=True):
        above = [y for y, p in rows if p >= t]
        tp = sum(above)
        ap += (tp - before) / positives * tp / len(above)
        before = tp
    return ap


def brute_ece(rows, bins=10):
    total, step = 0.0, 1.0 / bins
    for i in range(bins):
        lo, hi = i * step, 1.0 if i == bins - 1 else (i + 1) * step
        inside = [(y, p) for y, p in rows if p >= lo and (p < hi or (i == bins - 1 and p <= hi))]
        if inside:
            acc = sum(y for y, _ in inside) / len(inside)
            conf = sum(p for _, p in inside) / len(inside)
            total += abs(acc - conf) * len(inside) / len(rows)
    return total


@pytest.mark.parametrize("digits, one_task_rows", [(1, 10**6), (2, 5), (6, 10**6), (6, 20)])
def test_ranking_and_calibration_by_brute_force(spark, monkeypatch, digits, one_task_rows):
    monkeypatch.setattr(metrics, "ONE_TASK_ROWS", one_task_rows)
    rng = random.Random(digits)
    rows = [(rng.randint(0, 1), round(rng.random(), digits)) for _ in range(300)]
    got = metrics.classification_metrics(subjects(spark, rows)).first()
    assert got["auroc"] == pytest.approx(brute_auroc(rows), abs=1e-12)
    assert got["pr_auc"] == pytest.approx(brute_ap(rows), abs=1e-12)
    assert got["ece"] == pytest.approx(brute_ece(rows), abs=1e-12)
    assert got["brier_score"] == pytest.approx(sum((p - y) ** 2 for y, p in rows) / 300)


def test_one_class_gives_nan(spark):
    row = metrics.ranking_scores(subjects(spark, [(1, 0.2), (1, 0.7)])).first()
    assert math.isnan(row["auroc"]) and math.isnan(row["pr_auc"])
    assert metrics.roc_curve(subjects(spark, [(1, 0.2), (1, 0.7)])).count() == 0


def test_groups_are_independent(spark):
    a, b = [(1, 0.9), (0, 0.1)], [(1, 0.1), (0, 0.9), (0, 0.3)]
    both = subjects(spark, a).withColumn("run", F.lit("a")).unionByName(
        subjects(spark, b).withColumn("run", F.lit("b"))
    )
    got = {r["run"]: r["auroc"] for r in metrics.classification_metrics(both, ["run"]).collect()}
    assert got == {"a": 1.0, "b": 0.0}


def test_bin_edges(spark):
    # 0.3, 0.6 and 0.7 lie just below the edges of their bins
    rows = [(0, p) for p in (0.0, 0.1, 0.3, 0.6, 0.7, 0.95, 1.0)]
    bins = metrics.calibration_bins(subjects(spark, rows)).orderBy("bin_index").collect()
    assert [b["count"] for b in bins] == [1, 1, 1, 0, 0, 1, 1, 0, 0, 2]
    assert bins[3]["mean_confidence"] is None


def test_roc_curve_drops_collinear_points(spark):
    rows = [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (0, 0.5), (1, 0.4)]
    full = metrics.roc_curve(subjects(spark, rows), drop_intermediate=False)
    slim = metrics.roc_curve(subjects(spark, rows)).orderBy("tpr", "fpr").collect()
    assert full.count() == 7
    assert [(r["fpr"], r["tpr"]) for r in slim] == [
        (0.0, 0.0), (0.0, 0.25), (0.0, 0.75), (1.0, 0.75), (1.0, 1.0)
    ]


def window_rows(spark, sizes):
    rng = random.Random(3)
    rows = [(str(s), s % 2, round(rng.random(), 3)) for s, n in enumerate(sizes) for _ in range(n)]
    return rows, spark.createDataFrame(
        rows, "subject_id string, label int, window_probability double"
    )


@pytest.mark.parametrize("one_task_rows", [5, 10**6])
def test_methods_with_and_without_hot_subjects(spark, one_task_rows):
    rows, windows = window_rows(spark, [1, 2, 4, 5, 9, 400])
    got = aggregate.subject_scores(windows, one_task_rows=one_task_rows).collect()
    assert len(got) == 6
    for r in got:
        p = sorted((x for s, _, x in rows if s == r["subject_id"]), reverse=True)
        k = max(1, math.ceil(len(p) * 0.25))
        weights = [math.exp(x) for x in p]
        assert r["num_windows"] == len(p)
        assert r["mean"] == pytest.approx(sum(p) / len(p), abs=1e-10)
        assert r["topk"] == pytest.approx(sum(p[:k]) / k, abs=1e-10)
        attention = sum(x * w for x, w in zip(p, weights)) / sum(weights)
        assert r["attention"] == pytest.approx(attention, abs=1e-10)


def test_unknown_method(spark):
    _, windows = window_rows(spark, [1])
    with pytest.raises(ValueError, match="cannot be scored by"):
        aggregate.to_subjects(windows, "median")


def test_error_review(spark):
    df = subjects(spark, [(0, 0.9), (0, 0.7), (1, 0.2), (1, 0.4), (1, 0.8)])
    assert [r["probability"] for r in errors.top_false_positives(df).collect()] == [0.9, 0.7]
    assert [r["probability"] for r in errors.top_false_negatives(df).collect()] == [0.2, 0.4]
    counts = errors.error_counts(df.withColumn("num_windows", F.lit(2))).first()
    assert tuple(counts) == (2, 2, 5)
    assert errors.sparse_failures(df).count() == 0
