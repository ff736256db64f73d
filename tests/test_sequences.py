from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import normalise, sequence, skew, windows
from seqloom.plans import corpora


def sequence_df(spark, rows):
    return spark.createDataFrame(rows, "subject_id string, sec long, features array<double>, valid boolean")


def test_resample_rules(spark):
    frames = spark.createDataFrame(
        [
            ("a", 0.2, [1.0], 0.9, 1),
            ("a", 0.9, [3.0], 0.1, 1),
            # rounds up to 1.0 at single precision
            ("a", 0.99999999, [5.0], 0.9, 1),
            ("a", -0.5, [99.0], 1.0, 1),
            ("a", 3.1, [7.0], 0.4, 1),
            ("a", 4.0, [8.0], 0.9, 0),
            ("a", 4.5, [10.0], 0.9, 1),
        ],
        "subject_id string, ts double, features array<double>, confidence double, success int",
    )
    got = sequence.resample(frames, 1, quality="confidence", success="success").orderBy("sec")
    assert [(r["sec"], r["features"], r["valid"]) for r in got.collect()] == [
        (0, [2.0], True),
        (1, [5.0], True),
        (3, [7.0], False),
        (4, [9.0], False),
    ]
    plain = sequence.resample(frames, 1)
    assert plain.where("valid").count() == 4
    dense = sequence.fill_gaps(plain, 1).orderBy("sec").collect()
    assert [r["features"][0] for r in dense] == [2.0, 5.0, 0.0, 7.0, 9.0]
    assert [r["valid"] for r in dense] == [True, True, False, True, True]


def test_wide_vectors_use_the_same_mean(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(12, 136))
    frames = spark.createDataFrame(
        [("a", float(i // 3), [float(x) for x in v]) for i, v in enumerate(data)],
        "subject_id string, ts double, features array<double>",
    )
    for row in sequence.resample(frames, 136).collect():
        expected = data[row["sec"] * 3 : row["sec"] * 3 + 3].mean(axis=0)
        np.testing.assert_allclose(row["features"], expected, rtol=1e-12)
    seq = frames.select("subject_id", F.col("ts").alias("sec"), "features")
    stats = normalise.fit_stats(seq, 136, valid_only=False).first()
    np.testing.assert_allclose(stats["mean"], data.mean(axis=0), rtol=1e-10)
    np.testing.assert_allclose(stats["std"], data.std(axis=0), rtol=1e-10)


def test_variance_floor(spark):
    seq = sequence_df(spark, [("a", i, [5.0, float(i)], True) for i in range(4)])
    stats = normalise.fit_stats(seq, 2).first()
    assert stats["std"][0] == pytest.approx(1e-4)
    assert stats["std"][1] == pytest.approx(np.std([0, 1, 2, 3]))


def test_trim_keeps_interior_gaps(spark):
    seq = sequence_df(
        spark,
        [("a", 1, [1.0], False), ("a", 2, [2.0], True), ("a", 4, [4.0], False), ("a", 6, [6.0], True),
         ("a", 9, [9.0], False), ("b", 0, [0.0], False)],
    )
    got = sequence.trim_invalid(seq).orderBy("sec").collect()
    assert [(r["subject_id"], r["sec"], r["features"][0]) for r in got] == [
        ("a", 0, 2.0), ("a", 2, 4.0), ("a", 4, 6.0)
    ]


def test_align_cuts_to_the_shorter(spark):
    a = sequence_df(spark, [("a", 0, [1.0], True), ("a", 1, [2.0], True), ("a", 3, [3.0], True)])
    b = sequence_df(spark, [("a", 1, [5.0], False), ("a", 2, [6.0], True), ("c", 0, [1.0], True)])
    got = sequence.align(a, b, (1, 1)).orderBy("sec").collect()
    assert [(r["sec"], r["visual"], r["acoustic"], r["valid"]) for r in got] == [
        (0, [1.0], [0.0], False), (1, [2.0], [5.0], False), (2, [0.0], [6.0], False)
    ]


def brute_starts(length, size, stride):
    if length <= size:
        return [0]
    starts = list(range(0, length - size + 1, stride))
    if starts[-1] != length - size:
        starts.append(length - size)
    return starts


@pytest.mark.parametrize("size, stride", [(6, 3), (9, 4), (30, 15), (5, 5), (4, 7), (3, 1)])
def test_windows_by_brute_force(spark, size, stride):
    lens = {f"s{n}": n for n in range(1, 64)}
    df = spark.createDataFrame(list(lens.items()), "subject_id string, len long")
    index = windows.window_index(df, size, stride).collect()
    for name, n in lens.items():
        expected = brute_starts(n, size, stride)
        mine = sorted((r["window_idx"], r["start"]) for r in index if r["subject_id"] == name)
        assert mine == list(enumerate(expected))
    # every bin finds exactly the windows that contain it
    seq = df.select("subject_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)).alias("sec"))
    placed = windows.assign_windows(seq, df, size, stride).collect()
    got = {(r["subject_id"], r["start"], r["offset"]) for r in placed}
    want = {
        (name, start, o)
        for name, n in lens.items()
        for start in brute_starts(n, size, stride)
        for o in range(min(size, n))
    }
    assert got == want and len(placed) == len(want)


def test_numbering_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(windows, "INDEX_BLOCK", 7)
    rng = random.Random(5)
    rows = [(s, 4 * k) for s in "ab" for k in range(60) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "subject_id string, start long")
    got = {(r["subject_id"], r["start"]): r["window_idx"] for r in windows.number_windows(df, 4).collect()}
    for s in "ab":
        starts = sorted(start for name, start in rows if name == s)
        assert [got[(s, start)] for start in starts] == list(range(len(starts)))


def test_matrix_fills_gaps_and_pads(spark):
    seq = sequence_df(spark, [("a", 0, [1.0, 2.0], True), ("a", 2, [3.0, 4.0], True)])
    lens = sequence.lengths(seq)
    found = windows.valid_ratio(seq, lens, 5, 2, 0.5).withColumn("gap", F.array(F.lit(-1.0), F.lit(-2.0)))
    row = windows.to_matrix(
        found, seq, lens, 5, 2, {"features": 2}, gap_rows={"features": F.col("gap")}
    ).first()
    assert row["features"] == [[1.0, 2.0], [-1.0, -2.0], [3.0, 4.0], [0.0, 0.0], [0.0, 0.0]]
    assert row["valid_ratio"] == pytest.approx(2 / 3)


def test_valid_ratio_zero_keeps_empty_windows(spark):
    seq = sequence_df(spark, [("a", 0, [1.0], True), ("a", 11, [1.0], True)])
    lens = sequence.lengths(seq)
    all_windows = windows.valid_ratio(seq, lens, 3, 3, 0.0)
    assert {(r["start"], round(r["valid_ratio"], 3)) for r in all_windows.collect()} == {
        (0, 0.333), (3, 0.0), (6, 0.0), (9, 0.333)
    }


@pytest.mark.parametrize("hot, one_task_rows", [(0.34, 10), (0.95, 10), (0.5, 10**6)])
def test_ordered_prefix_with_a_hot_group(spark, hot, one_task_rows):
    rng = random.Random(11)
    rows = {}
    for i in range(2000):
        group = "hot" if rng.random() < hot else f"g{i % 40}"
        rows[(group, rng.randint(0, 10**6))] = rng.randint(0, 5)
    df = spark.createDataFrame([(g, v, n) for (g, v), n in rows.items()], "g string, v long, n long")
    got = skew.ordered_prefix(df, ["g"], -F.col("v"), ["n"], ["n"], one_task_rows).collect()
    sizes = {g: sum(n for (x, _), n in rows.items() if x == g) for g in {x for x, _ in rows}}
    assert len(got) == len(rows)
    for r in got:
        if r["g"] != "hot" or r["v"] % 17 == 0:
            larger = [(v, n) for (g, v), n in rows.items() if g == r["g"] and v > r["v"]]
            smaller = [(v, n) for (g, v), n in rows.items() if g == r["g"] and v < r["v"]]
            assert r["before_n"] == sum(n for _, n in larger)
            assert r["total_n"] == sizes[r["g"]]
            assert r["next_n"] == (max(smaller)[1] if smaller else None)


def test_expand_range_in_blocks(spark):
    df = spark.createDataFrame([("a", 10), ("b", 0), ("c", 1)], "k string, n long")
    got = skew.expand_range(df, F.col("n"), "i", ["k"], block=3)
    assert sorted((r["k"], r["i"]) for r in got.collect()) == [("a", i) for i in range(10)] + [("c", 0)]


def test_join_spread_equals_join(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    side = spark.createDataFrame([(0, "x"), (1, "y")], "k long, v string")
    spread = skew.join_spread(rows, side, ["k"], "id", parts=7)
    assert sorted(map(tuple, spread.collect())) == sorted(
        (r["k"], r["id"], r["v"]) for r in rows.join(side, "k").collect()
    )


def test_join_spread_copies_by_length(spark, monkeypatch):
    """A short key has one copy, a long one as many as it has blocks, up to the number of parts."""
    monkeypatch.setattr(skew, "SPREAD_BLOCK", 10)
    side = spark.createDataFrame([(0, 9), (1, 10), (2, 55), (3, 10**6)], "k long, last long")
    rows = spark.createDataFrame([(k, s) for k in range(5) for s in range(60)], "k long, sec long")
    spread = skew.join_spread(rows, side, ["k"], "sec", parts=8, last=F.col("last"))
    found = spread.where("sec <= last")
    assert sorted(map(tuple, found.collect())) == sorted(
        map(tuple, rows.join(side, "k").where("sec <= last").collect())
    )
    copies = skew.join_spread(rows.limit(0), side, ["k"], "sec", "right", parts=8, last=F.col("last"))
    assert {r["k"]: r["count"] for r in copies.groupBy("k").count().collect()} == {0: 1, 1: 2, 2: 6, 3: 8}


def test_windows_join_one_copy_of_a_label(spark, monkeypatch):
    copied = []
    real = corpora.join_spread

    def counted(rows, per_key, on, spread, how="inner", **kwargs):
        copied.append(real(rows.limit(0), per_key, on, spread, "right", **kwargs).count())
        return real(rows, per_key, on, spread, how, **kwargs)

    monkeypatch.setattr(corpora, "join_spread", counted)
    monkeypatch.setattr(sequence, "join_spread", counted)
    df = spark.createDataFrame([(s, float(t), [1.0 * t]) for s in range(3) for t in range(20)], "subject_id long, ts double, features array<double>")
    labels = spark.createDataFrame([(s, "train", s % 2, s) for s in range(500)], "subject_id long, fold string, label_binary int, phq int")
    prepared = corpora.prepare_e({"acoustic": df}, {"acoustic": 1}, labels, "acoustic")
    assert corpora.window_items(prepared, labels, "edaic").count() == 3
    assert copied == [3, 3]


def test_stats_source_and_fold_rules(spark):
    table = spark.createDataFrame([("train", 0), ("provided", 0)], "source string, dim int")
    assert normalise.load_stats(table, "provided").count() == 1
    with pytest.raises(ValueError):
        normalise.load_stats(table, "guess")
    with pytest.raises(ValueError):
        normalise.stats_for_fold("dev", None, lambda: table)
    assert normalise.stats_for_fold("train", None, lambda: table) is table


def numpy_corpus_e(frames, size, stride, min_len, ratio):
    """Plain loop over one modality: resample, trim, statistics, windows."""
    prepared = {}
    for s, rows in frames.items():
        ts = np.array([r[0] for r in rows], np.float32)
        x = np.array([r[1] for r in rows])
        secs = np.floor(ts).astype(int)
        length = secs.max() + 1
        dense, valid = np.zeros((length, x.shape[1])), np.zeros(length, bool)
        for sec in set(secs):
            dense[sec], valid[sec] = x[secs == sec].mean(axis=0), True
        where = np.flatnonzero(valid)
        dense, valid = dense[where[0] : where[-1] + 1], valid[where[0] : where[-1] + 1]
        if len(valid) >= min_len:
            prepared[s] = (dense, valid)
    train = np.concatenate([d[v] for s, (d, v) in prepared.items() if s % 2 == 0])
    mean, std = train.mean(axis=0), np.sqrt(np.maximum(train.var(axis=0), 1e-8))
    items = {}
    for s, (dense, valid) in prepared.items():
        number = 0
        for start in brute_starts(len(valid), size, stride):
            part = valid[start : start + size]
            if part.mean() >= ratio:
                z = (dense[start : start + size] - mean) / std
                items[(s, number)] = np.pad(z, ((0, size - len(z)), (0, 0)))
                number += 1
    return items


def test_corpus_e_against_a_loop(spark):
    rng = np.random.default_rng(7)
    frames = {
        s: [(float(t), rng.normal(size=3)) for t in sorted(rng.uniform(0, rng.integers(12, 60), 80))]
        for s in range(8)
    }
    df = spark.createDataFrame(
        [(s, t, [float(v) for v in x]) for s, rows in frames.items() for t, x in rows],
        "subject_id long, ts double, features array<double>",
    )
    labels = spark.createDataFrame(
        [(s, "train" if s % 2 == 0 else "dev", s % 2, s) for s in frames],
        "subject_id long, fold string, label_binary int, phq int",
    )
    config = corpora.WindowConfig(size=9, stride=4, min_len=15, min_valid_ratio=0.6)
    prepared = corpora.prepare_e({"acoustic": df}, {"acoustic": 3}, labels, "acoustic", config)
    items = corpora.window_items(prepared, labels, "edaic", config).collect()
    expected = numpy_corpus_e(frames, 9, 4, 15, 0.6)
    assert {(r["subject_id"], r["window_idx"]) for r in items} == set(expected)
    for r in items:
        np.testing.assert_allclose(
            np.array(r["acoustic"]), expected[(r["subject_id"], r["window_idx"])], atol=1e-8
        )
    with pytest.raises(ValueError, match="No frames are kept"):
        corpora.prepare_e({}, {}, labels, "thermal")
