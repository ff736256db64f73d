"""Staged model selection: window size, training policy, capacity, normalisation, then one locked run.

The driver walks the (few) candidates; every fit, score and metric is a Spark job over all windows.
All seeds of a candidate are evaluated in one job. With a :class:`~seqloom.plans.ledger.Store` each
experiment is written and committed before the next one starts, a search that was killed goes on
where it ended, and the locked run takes its settings from the stored ledger.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import aggregate, metrics, model, selection
from seqloom.plans.ledger import Store, settings_key
from seqloom.session import checkpointed, new_shared_path, register

# Labels of the run records (with ``window_NN``, ``norm_*`` and ``locked_run`` below).
STAGES = ("stage_a", "stage_b", "stage_c", "stage_d")
METRICS = ("macro_f1", "weighted_f1", "precision", "recall", "brier_score")
LEDGER_SCHEMA = (
    "track string, dataset string, stage string, position int, candidate string, "
    "selected_aggregation string, macro_f1_mean double, selected boolean, config string"
)


@dataclass(frozen=True)
class Candidate:
    name: str
    overrides: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Suite:
    """What is tried in each stage. ``windows(config)`` returns the windows of a configuration:
    ``subject_id, window_idx, features, label_binary, fold``."""

    track: str
    dataset: str
    windows: Callable[[dict], DataFrame]
    base: dict
    window_sizes: Sequence[int]
    policies: Sequence[Candidate]
    capacities: Sequence[Candidate]
    normalisations: Sequence[str] = ("train",)
    stride_policy: str = "half_window"
    methods: Sequence[str] = aggregate.METHODS
    dev_seeds: Sequence[int] = (7, 17, 27)
    final_seeds: Sequence[int] = (7, 17, 27, 37, 47)


def train_config(config: dict) -> model.TrainConfig:
    names = model.TrainConfig.__dataclass_fields__
    return model.TrainConfig(**{k: v for k, v in config.items() if k in names})


def _predictions(
    windows: DataFrame, config: dict, seeds: Sequence[int], folds: Sequence[str]
) -> DataFrame:
    """Window predictions of every seed.

    The seed enters through balanced sampling only. Without it all seeds give the same model, which
    is then fitted once.
    """
    key = F.concat_ws("-", F.col("subject_id").cast("string"), F.col("window_idx").cast("string"))
    setup = train_config(config)
    groups = [[seed] for seed in seeds] if setup.balanced_sampling else [list(seeds)]
    scored = [
        model.train_and_score(
            windows, setup, group[0], key=key, score_folds=tuple(folds)
        ).select(
            F.explode(F.array(*[F.lit(seed) for seed in group])).alias("seed"),
            "fold",
            F.col("subject_id").cast("string").alias("subject_id"),
            F.col("label_binary").alias("label"),
            "window_probability",
        )
        for group in groups
    ]
    return reduce(lambda a, b: a.unionByName(b), scored)


def run_experiment(
    windows: DataFrame | Callable[[], DataFrame],
    config: dict,
    seeds: Sequence[int],
    methods: Sequence[str],
    folds: Sequence[str] = ("dev",),
    store: Store | None = None,
) -> DataFrame:
    """One metrics row per (fold, seed, method).

    With a store, predictions and metrics are written under the key of all these settings; an experiment
    that is there is read back, and its ``windows``, if given as a function, are not even made.
    """
    def made():
        return windows() if callable(windows) else windows

    if store is None:
        return _metrics_of(checkpointed(_predictions(made(), config, seeds, folds)), methods)
    key = settings_key({"config": config, "seeds": list(seeds), "folds": list(folds)})
    by_method = f"metrics-{'-'.join(methods)}"

    def scored():
        return store.table(
            ("experiments", key, "predictions"), lambda: _predictions(made(), config, seeds, folds)
        )

    return store.table(("experiments", key, by_method), lambda: _metrics_of(scored(), methods))


def _metrics_of(predictions: DataFrame, methods: Sequence[str]) -> DataFrame:
    subjects = aggregate.to_subjects_all(predictions, methods, by=["fold", "seed"])
    return metrics.with_scores(metrics.confusion(subjects, ["fold", "seed", "method"]))


def _evaluate_stage(
    suite: Suite, stage: str, candidates: Sequence[tuple[str, dict]], cache: dict, store: Store
) -> tuple[list[Row], Row]:
    """Ledger rows of a stage and the chosen one. Only candidate-level summaries reach the driver.

    ``cache`` keeps windows per shape; metrics are kept by the store, so the candidate that repeats
    the configuration chosen before is not trained again.
    """
    runs = []
    for position, (name, config) in enumerate(candidates):
        shape = (config["window_size"], config["stride"], config["normalization_source"])

        def windows(shape=shape, config=config):
            if shape not in cache:
                cache[shape] = checkpointed(suite.windows(config))
            return cache[shape]

        run = run_experiment(windows, config, suite.dev_seeds, suite.methods, store=store)
        runs.append(
            run.select(
                F.lit(name).alias("candidate"), F.lit(position).alias("position"), "method", "macro_f1"
            )
        )
    records = reduce(lambda a, b: a.unionByName(b), runs)
    best = selection.select_method(records, ["candidate", "position"], suite.methods)
    ranked = best.orderBy("position").collect()
    score = [round(row["score"], 12) for row in ranked]
    chosen = score.index(max(score))
    rows = [
        Row(
            track=suite.track,
            dataset=suite.dataset,
            stage=stage,
            position=row["position"],
            candidate=row["candidate"],
            selected_aggregation=row["selected_aggregation"],
            macro_f1_mean=row["score"],
            selected=i == chosen,
            config=json.dumps(candidates[i][1], sort_keys=True),
        )
        for i, row in enumerate(ranked)
    ]
    return rows, rows[chosen]


@dataclass
class Ledger:
    rows: list[Row]
    final_config: dict | None = None
    frozen_aggregation: str | None = None

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, LEDGER_SCHEMA)


def load_ledger(store: Store, track: str) -> Ledger | None:
    """The ledger of a finished search of ``track``; None if none has been committed."""
    if not store.committed("ledger", track):
        return None
    found = store.spark.read.schema(LEDGER_SCHEMA).parquet(store.path("ledger", track))
    rows = found.orderBy("stage", "position").collect()  # one row per candidate
    final = next((r for r in reversed(rows) if r["selected"]), None)
    if final is None:
        return Ledger(rows)
    return Ledger(rows, json.loads(final["config"]), final["selected_aggregation"])


def staged_search(suite: Suite, store: Store | None = None) -> Ledger:
    """Greedy stages on the dev fold: each starts from the configuration chosen before it.

    Experiments found in ``store`` are not run again; the finished ledger is written there. Without
    a store a folder of its own is used.
    """
    if store is None:
        spark = SparkSession.getActiveSession()
        store = Store(spark, register(new_shared_path(spark, "search")))
    cache: dict = {}
    rows: list[Row] = []
    config = {"normalization_source": suite.normalisations[0], **suite.base}

    def stage(name: str, options: Sequence[tuple[str, dict]]) -> dict:
        candidates = [(n, selection.merge_config(config, o)) for n, o in options]
        new_rows, chosen = _evaluate_stage(suite, name, candidates, cache, store)
        rows.extend(new_rows)
        return candidates[chosen["position"]][1]

    config = stage(
        "stage_a",
        [
            (
                f"window_{size:02d}",
                {"window_size": size, "stride": selection.stride_for(size, suite.stride_policy)},
            )
            for size in suite.window_sizes
        ],
    )
    config = stage("stage_b", [(c.name, c.overrides) for c in suite.policies])
    config = stage("stage_c", [(c.name, c.overrides) for c in suite.capacities])
    if len(suite.normalisations) > 1:
        config = stage(
            "stage_d",
            [(f"norm_{s}", {"normalization_source": s}) for s in suite.normalisations],
        )
    else:
        # nothing to choose: the stage is recorded with the result of the one before
        last = next(r for r in reversed(rows) if r["selected"])
        rows.append(
            Row(**{**last.asDict(), "stage": "stage_d", "position": 0,
                   "candidate": f"norm_{suite.normalisations[0]}"})
        )
    final = next(r for r in reversed(rows) if r["selected"])
    ledger = Ledger(rows, config, final["selected_aggregation"])
    store.table(("ledger", suite.track), lambda: ledger.to_df(store.spark).coalesce(1))
    return ledger


def finalize(suite: Suite, ledger: Ledger | None, store: Store | None = None) -> DataFrame:
    """The locked run: frozen configuration and aggregation, final seeds, dev and test folds.

    One row per fold with mean and deviation of each metric over the seeds.
    """
    if ledger is None:
        raise RuntimeError("The locked run takes its settings from a search, and none was given.")
    if not ledger.final_config or not ledger.frozen_aggregation:
        raise RuntimeError(f"The search of {suite.track} ended without a chosen configuration.")
    runs = run_experiment(
        lambda: checkpointed(suite.windows(ledger.final_config)),
        ledger.final_config,
        suite.final_seeds,
        [ledger.frozen_aggregation],
        ("dev", "test"),
        store,
    )
    summary = selection.seed_summary(runs, ["fold"], METRICS)
    return summary.select(
        F.lit(suite.track).alias("track"),
        F.lit(suite.dataset).alias("dataset"),
        F.lit("locked_run").alias("candidate"),
        F.lit(ledger.frozen_aggregation).alias("selected_aggregation"),
        *summary.columns,
    )
