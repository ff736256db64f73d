"""Input that the driver tables do not hold: odd labels, NULL groups, times without a value."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.errors import PySparkException

from seqloom.operators import audit, metrics, normalise, quantile, sampling, sequence, skew
from seqloom.plans import corpora


@pytest.mark.parametrize("label", [2, None])
def test_a_label_outside_the_classes_fails(spark, label):
    rows = [(i, i % 2) for i in range(20)] + [(99, label)]
    windows = spark.createDataFrame(rows, "id long, label_binary int")
    with pytest.raises(PySparkException):
        sampling.class_weights(windows).collect()


def test_non_finite_times_are_dropped(spark):
    rows = [("s", t, [1.0]) for t in (0.2, 0.4, 3.5, float("nan"), float("inf"), -1.0)] + [("s", None, [1.0])]
    frames = spark.createDataFrame(rows, "subject_id string, ts double, features array<double>")
    assert sorted(r["sec"] for r in sequence.resample(frames, 1).collect()) == [0, 3]


def subjects(spark):
    rows = [(track, f"s{i}", i % 2, 0.1 + 0.08 * i, i // 5) for track in ("a", None) for i in range(10)]
    return spark.createDataFrame(
        rows, "track string, subject_id string, label int, probability double, prediction int"
    )


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_null_groups_stay_at_any_size(spark, monkeypatch, limit):
    monkeypatch.setattr(skew, "ONE_TASK_ROWS", limit)
    monkeypatch.setattr(metrics, "ONE_TASK_ROWS", limit)
    found = metrics.classification_metrics(subjects(spark), by=["track"]).collect()
    by_track = {r["track"]: r.asDict() for r in found}
    assert set(by_track) == {"a", None}
    first, second = ({k: v for k, v in r.items() if k != "track"} for r in by_track.values())
    # Sums of doubles may be added in another order.
    assert first == pytest.approx(second, rel=1e-12)


@pytest.mark.parametrize("width", [2, 65])
def test_null_elements_are_skipped_at_any_width(spark, width):
    rows = [("s", 0.0, [1.0] * width, True), ("s", 0.5, [None] + [3.0] * (width - 1), True)]
    frames = spark.createDataFrame(rows, "subject_id string, ts double, features array<double>, valid boolean")
    assert sequence.resample(frames, width).first()["features"] == [1.0] + [2.0] * (width - 1)
    stats = normalise.fit_stats(frames, width).first()
    assert stats["mean"] == [1.0] + [2.0] * (width - 1)
    assert stats["std"] == pytest.approx([1e-4] + [1.0] * (width - 1))


def test_empty_severity_bands_are_kept(spark):
    rows = spark.createDataFrame([(1, 3), (2, 14), (3, 12)], "subject_id long, phq int")
    got = [(r["band"][:2], r["count"]) for r in audit.severity_histogram(rows).orderBy("band_order").collect()]
    assert got == [("0-", 1), ("5-", 0), ("10", 2), ("15", 0), ("20", 0)]


def test_uneven_and_short_sequences(spark):
    """Both modalities are cut to the shorter; what is too short counts for the statistics only."""
    lens = {1: (10, 9), 2: (10, 10), 3: (4, 4), 4: (7, 12), 5: (6, 0)}
    frames = {
        name: spark.createDataFrame(
            [(s, sec, [float(s + sec)]) for s, both in lens.items() for sec in range(both[m])],
            "subject_id long, sec long, features array<double>",
        )
        for m, name in enumerate(("visual", "acoustic"))
    }
    labels = spark.createDataFrame([(s, s % 2, "train") for s in lens], "subject_id long, label_binary int, fold string")
    config = corpora.WindowConfig(size=4, stride=3, min_len=5)
    prepared = corpora.prepare_d(frames, {"visual": 1, "acoustic": 1}, labels, config)
    assert {r["subject_id"]: r["len"] for r in prepared.lengths.collect()} == {1: 9, 2: 10, 4: 7}
    counted = [s + sec for s, (v, a) in lens.items() for sec in range(min(v, a))]
    mean = prepared.stats.where("modality = 'visual'").first()["mean"][0]
    assert abs(mean - sum(counted) / len(counted)) < 1e-9
    items = corpora.window_items(prepared, labels, "dvlog", config, check_validity=False)
    starts = sorted((r["subject_id"], r["start"]) for r in items.collect())
    assert starts == [(1, 0), (1, 3), (1, 5), (2, 0), (2, 3), (2, 6), (4, 0), (4, 3)]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_statistics_of_a_continuous_column_with_one_large_group(spark, monkeypatch, limit):
    monkeypatch.setattr(quantile, "ONE_TASK_ROWS", limit)
    rnd = random.Random(3)
    rows = [("big" if rnd.random() < 0.8 else None, rnd.gauss(5, 3)) for _ in range(3000)]
    rows += [("big", None), ("big", float("nan")), ("odd", 1.0), ("odd", 2.0), ("odd", 2.0), ("none", None)]
    values = spark.createDataFrame(rows, "part string, x double")
    found = {r["part"]: r for r in audit.numeric_stats(values, "x", ["part"]).collect()}
    assert set(found) == {"big", None, "odd"}
    for part, row in found.items():
        want = [x for p, x in rows if p == part and x is not None and x == x]
        assert (row["min"], row["max"]) == (min(want), max(want))
        assert row["median"] == pytest.approx(statistics.median(want))
        assert row["mean"] == pytest.approx(statistics.fmean(want))
        assert row["std"] == pytest.approx(statistics.pstdev(want))
    assert audit.numeric_stats(values.limit(0), "x", ["part"]).count() == 0
    ages = spark.createDataFrame([(3,), (4,), (None,)], "age int")
    assert audit.numeric_stats(ages, "age").collect() == [(3, 4, 3.5, 3.5, 0.5)]


def test_array_issues_of_damaged_and_single_precision_files(spark):
    rows = [("1", "visual", "float64", None), ("2", "visual", "float32", None), ("3", "acoustic", None, "EOF")]
    listing = spark.createDataFrame(rows, "subject_id string, modality string, dtype string, error string")
    assert {tuple(r) for r in audit.array_issues(listing).collect()} == {
        ("2", "visual", "dtype", "float32"), ("3", "acoustic", "corrupt", None)
    }
