from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import losses
from seqloom.functions.randomness import whole_copies
from seqloom.operators import audit, model, sampling, selection
from seqloom.plans import search
from seqloom.plans.ledger import Store


def test_best_epoch_of_a_published_history(spark):
    scores = [0.69412, 0.62616, 0.64928, 0.65828, 0.66932, 0.66343, 0.99]
    rows = [("a", i + 1, s) for i, s in enumerate(scores)]
    rows += [("b", 1, 0.5), ("b", 2, 0.5), ("b", 3, 0.6), ("b", 4, 0.4)]
    history = spark.createDataFrame(rows, "run string, epoch int, dev_macro_f1 double")
    got = {r["run"]: tuple(r)[1:] for r in selection.best_epoch(history, ["run"], 5).collect()}
    assert got["a"] == (1, 0.69412, 6)
    assert got["b"] == (3, 0.6, 4)


def test_seed_summary_ignores_nan(spark):
    nan = float("nan")
    rows = [("x", 0.5, nan, 1.0), ("x", 0.7, nan, nan), ("y", 0.1, 0.2, 0.3)]
    runs = spark.createDataFrame(rows, "k string, a double, b double, c double")
    got = {r["k"]: r for r in selection.seed_summary(runs, ["k"], ["a", "b", "c"]).collect()}
    assert got["x"]["a_mean"] == pytest.approx(0.6) and got["x"]["a_std"] == pytest.approx(0.1)
    assert math.isnan(got["x"]["b_mean"]) and math.isnan(got["x"]["b_std"])
    assert (got["x"]["c_mean"], got["x"]["c_std"]) == (1.0, 0.0)


def test_first_listed_wins_a_tie(spark):
    rows = [("e", m, 0.5) for m in ("attention", "topk", "mean")] + [("f", "topk", 0.9), ("f", "mean", 0.1)]
    runs = spark.createDataFrame(rows, "k string, method string, macro_f1 double")
    got = selection.select_method(runs, ["k"], ("mean", "topk", "attention")).collect()
    assert {r["k"]: r["selected_aggregation"] for r in got} == {"e": "mean", "f": "topk"}


def test_configuration_rules():
    merged = selection.merge_config({"a": {"x": 1, "y": 2}, "b": 3}, {"a": {"y": 5}, "c": 7})
    assert merged == {"a": {"x": 1, "y": 5}, "b": 3, "c": 7}
    assert [selection.stride_for(n, "half_window") for n in (1, 9, 30)] == [1, 4, 15]
    assert selection.stride_for(9, "fixed_15") == 15
    with pytest.raises(ValueError):
        selection.stride_for(9, "other")


def test_losses_match_the_formula(spark):
    rows = [(z, y) for z in (-50.0, -1.3, 0.0, 2.0, 60.0) for y in (0, 1)]
    df = spark.createDataFrame(rows, "z double, y int")
    got = df.select(
        losses.bce_with_logits(F.col("z"), F.col("y"), 3.0), losses.focal(F.col("z"), F.col("y"))
    ).collect()
    for (z, y), (bce, focal) in zip(rows, got):
        log_p = -math.log1p(math.exp(-z)) if z > -30 else z
        log_q = -math.log1p(math.exp(z)) if z < 30 else -z
        assert bce == pytest.approx(-(3.0 * y * log_p + (1 - y) * log_q), abs=1e-9)
        pt = math.exp(log_p if y else log_q)
        plain = -(log_p if y else log_q)
        assert focal == pytest.approx((0.75 if y else 0.25) * (1 - pt) ** 2 * plain, abs=1e-9)
    with pytest.raises(ValueError):
        losses.window_loss("hinge", F.lit(0.0), F.lit(0))


def test_copies_of_a_rate(spark):
    df = spark.range(1000).select(((F.col("id") + 0.5) / 1000).alias("u"))
    for rate in (0.2, 1.0, 40.25, 900.5):
        drawn = df.select(whole_copies(F.lit(rate), F.col("u")).alias("n"))
        mean, low, high = drawn.agg(F.avg("n"), F.min("n"), F.max("n")).first()
        assert mean == pytest.approx(rate, abs=0.002)
        assert (low, high) == (math.floor(rate), math.ceil(rate))


def test_one_positive_in_a_million(spark):
    df = spark.range(1_000_000).select("id", (F.col("id") == 5).cast("int").alias("label_binary"))
    drawn = sampling.weighted_resample(df, F.col("id"), 7)
    rows = {r["label_binary"]: r for r in drawn.groupBy("label_binary").agg(
        F.count("*").alias("n"), F.countDistinct("copy").alias("copies"), F.max("copy").alias("last")).collect()}
    assert rows[1]["n"] == rows[1]["copies"] == rows[1]["last"] == 500_000
    assert rows[0]["n"] == pytest.approx(500_000, rel=0.01)
    tasks = drawn.where("label_binary = 1").groupBy(F.spark_partition_id()).count()
    assert tasks.count() > 1


def test_balanced_resample(spark):
    df = spark.range(20000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label_binary"))
    drawn = sampling.weighted_resample(df, F.col("id"), 7)
    counts = {r["label_binary"]: r["count"] for r in drawn.groupBy("label_binary").count().collect()}
    assert counts[0] == pytest.approx(10000, rel=0.05) and counts[1] == pytest.approx(10000, rel=0.05)
    again = sampling.weighted_resample(df.repartition(13), F.col("id"), 7)
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, again.collect()))
    assert sampling.weighted_resample(df, F.col("id"), 8).count() != drawn.count()


def test_fold_overlap_and_rates(spark):
    rows = [(1, "train", 1), (2, "train", 0), (2, "test", 0), (3, "dev", 1)]
    df = spark.createDataFrame(rows, "subject_id int, fold string, label_binary int")
    got = {(r["fold_a"], r["fold_b"]): (r["overlap"], r["status"], r["total_subjects"])
           for r in audit.fold_overlap(df, ["train", "dev", "test"]).collect()}
    assert got[("train", "test")] == (1, "FAIL", 3) and got[("dev", "test")] == (0, "PASS", 3)
    # 17 of 80 is 0.2125: half to even
    many = spark.range(80).select(F.lit("a").alias("fold"), (F.col("id") < 17).cast("int").alias("label_binary"))
    assert audit.split_rates(many).first()["rate"] == 0.212


def test_window_features_and_fusion(spark):
    df = spark.createDataFrame([([[1.0, 4.0], [3.0, 0.0], [0.0, 0.0]],), ([[0.0, 0.0]],)], "m array<array<double>>")
    got = [r[0] for r in df.select(model.window_features(F.col("m"), 2)).collect()]
    assert got[0] == [2.0, 2.0, 1.0, 2.0, 1.0, 0.0, 3.0, 4.0]
    assert got[1] == [0.0] * 8
    fused = df.limit(1).select(model.fuse(F.array(F.lit(1.0)), F.array(F.lit(3.0)), 0.25)).first()[0]
    assert fused == [0.25 + 2.25, 2.0, 3.0, 0.25, 2.25]


def test_finalize_needs_a_ledger(spark):
    suite = search.Suite("t", "d", None, {}, (), (), ())
    with pytest.raises(RuntimeError):
        search.finalize(suite, None)
    with pytest.raises(RuntimeError):
        search.finalize(suite, search.Ledger([], None, None))


def test_search_picks_the_informative_window(spark):
    def windows(config):
        noise = F.rand(3) if config["window_size"] == 4 else F.lit(0.0)
        base = spark.range(400).select(
            F.col("id").alias("subject_id"), F.lit(0).alias("window_idx"),
            (F.col("id") % 2).cast("int").alias("label_binary"),
            F.when(F.col("id") % 10 < 7, "train").when(F.col("id") % 10 == 7, "dev")
            .otherwise(F.when(F.col("id") % 20 == 8, "dev").otherwise("test")).alias("fold"),
        )
        signal = F.lit(0.0) if config["window_size"] == 4 else F.col("label_binary") * 2.0
        return base.withColumn("features", F.array(signal + noise, F.lit(1.0)))

    suite = search.Suite(
        "t", "edaic", windows, {"max_iter": 5}, (4, 6),
        (search.Candidate("plain", {"balanced_sampling": False}),),
        (search.Candidate("reg", {"reg_param": 0.01}),), dev_seeds=(7,), final_seeds=(7, 17),
    )
    ledger = search.staged_search(suite)
    chosen = {r["stage"]: r["candidate"] for r in ledger.to_df(spark).where("selected").collect()}
    assert chosen == {"stage_a": "window_06", "stage_b": "plain", "stage_c": "reg", "stage_d": "norm_train"}
    assert ledger.final_config["window_size"] == 6
    final = {r["fold"]: r for r in search.finalize(suite, ledger).collect()}
    assert final["test"]["macro_f1_mean"] == pytest.approx(1.0) and final["test"]["num_seeds"] == 2


def small_suite(spark, made):
    rng = random.Random(2)
    rows = [
        (str(s), w, [rng.gauss(0.8 * (s % 2), 1), rng.gauss(0, 1)], s % 2, "train" if s < 60 else "dev" if s < 90 else "test")
        for s in range(120)
        for w in range(3)
    ]
    df = spark.createDataFrame(
        rows, "subject_id string, window_idx long, features array<double>, label_binary int, fold string"
    )

    def windows(config):
        made.append(config["window_size"])
        return df

    return search.Suite(
        track="t", dataset="d", windows=windows, base={"window_size": 3, "stride": 1, "max_iter": 3},
        window_sizes=(3, 4), policies=(search.Candidate("plain", {}), search.Candidate("weighted", {"use_pos_weight": True})),
        capacities=(search.Candidate("small", {"reg_param": 0.1}),), dev_seeds=(7,), final_seeds=(7, 17), methods=("mean", "topk"),
    )


def test_a_killed_search_goes_on_where_it_ended(spark, tmp_path, monkeypatch):
    """Finished experiments are read back; a half-written one is done again; the ledger is the last thing."""
    calls, real = [], search.model.train_and_score

    def dying(*args, **options):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return real(*args, **options)

    monkeypatch.setattr(search.model, "train_and_score", dying)
    whole, broken = (Store(spark, str(tmp_path / n)) for n in ("whole", "broken"))
    with pytest.raises(KeyboardInterrupt):
        search.staged_search(small_suite(spark, []), broken)
    assert len([c for c in broken.computed if c.endswith("predictions")]) == 2
    assert search.load_ledger(broken, "t") is None
    with pytest.raises(RuntimeError, match="none was given"):
        search.finalize(small_suite(spark, []), search.load_ledger(broken, "t"), broken)
    # What a killed job leaves: files without the marker.
    victim = next(c for c in broken.computed if c.endswith("predictions"))
    for marker in (tmp_path / "broken" / victim).glob("*_SUCCESS*"):
        marker.unlink()
    folder = victim.rsplit("/", 1)[0]
    for marker in (tmp_path / "broken" / folder).glob("metrics-*/*_SUCCESS*"):
        marker.unlink()
    calls[:] = [0] * 10
    again = Store(spark, str(tmp_path / "broken"))
    resumed = search.staged_search(small_suite(spark, []), again)
    assert victim in again.computed
    trained = len(calls) - 10
    calls[:] = [0] * 10
    complete = search.staged_search(small_suite(spark, []), whole)
    assert len(calls) - 10 == trained + 1  # one experiment was read back
    assert resumed.rows == complete.rows and resumed.final_config == complete.final_config
    # A third run trains nothing and makes no windows.
    calls[:], made = [0] * 10, []
    third = search.staged_search(small_suite(spark, made), Store(spark, str(tmp_path / "whole")))
    assert third.rows == complete.rows and len(calls) == 10 and made == []

    # The stored ledger: stages in order, one choice each, the first best candidate wins.
    ledger = search.load_ledger(whole, "t")
    assert [tuple(r) for r in ledger.rows] == [tuple(r) for r in complete.rows]
    assert ledger.final_config == complete.final_config
    for stage in search.STAGES:
        rows = [r for r in ledger.rows if r["stage"] == stage]
        best = max(round(r["macro_f1_mean"], 12) for r in rows)
        first = next(r for r in rows if round(r["macro_f1_mean"], 12) == best)
        assert [r for r in rows if r["selected"]] == [first]

    # The stored metrics, told again by SQL from the stored predictions.
    import duckdb

    con = duckdb.connect()
    con.register("p", whole.predictions().toPandas())
    told = con.execute(
        """WITH s AS (SELECT key, fold, seed, subject_id, min(label) AS y, avg(window_probability) AS p FROM p GROUP BY ALL),
        c AS (SELECT key, fold, seed, sum((y = 1 AND p >= 0.5)::INT) AS tp, sum((y = 0 AND p >= 0.5)::INT) AS fp,
                     sum((y = 1 AND p < 0.5)::INT) AS fn, sum((y = 0 AND p < 0.5)::INT) AS tn FROM s GROUP BY ALL)
        SELECT key, tp, fp, fn, tn, (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2 FROM c"""
    ).fetchall()
    stored = {r["key"]: r for r in whole.metrics().where("method = 'mean'").collect()}
    assert len(told) == len(stored) >= 3
    for key, tp, fp, fn, tn, macro in told:
        r = stored[key]
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (tp, fp, fn, tn)
        assert r["macro_f1"] == pytest.approx(macro)
