"""Whole corpus plans, pooled window features, training, staged search."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.q_sequence import matrix_sql, starts_sql, trimmed_sql, _matrix
from catalog.registry import long, query, r8
from catalog.tables import (
    FRAME_WIDTH,
    SUBJECTS_SQL,
    VECTOR_FRAMES_SQL,
    VECTOR_WIDTH,
    frames,
    subjects,
    vector_frames,
)
from seqloom.operators import aggregate, metrics, model
from seqloom.plans import corpora, search
from seqloom.plans.ledger import Store
from seqloom.session import checkpointed, new_shared_path, register

POOL_SQL = ", ".join(
    f"""round(coalesce({fn}(f{i}) FILTER (f0 <> 0 OR f1 <> 0), 0), 9) AS {name}{i}"""
    for name, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))
    for i in range(FRAME_WIDTH)
)


@query(
    "ml_window_features",
    matrix_sql(30, 15, 0.5, True)
    + f" SELECT subject_id, modality, start, {POOL_SQL} FROM matrix GROUP BY subject_id, modality, start",
)
def ml_window_features(spark, sf_dir):
    matrix = _matrix(spark, sf_dir, 30, 15, 0.5, pad=True)
    pooled = matrix.withColumn("v", model.window_features(F.col("features"), FRAME_WIDTH))
    return pooled.select(
        "subject_id",
        "modality",
        "start",
        *[
            r8(F.col("v")[p * FRAME_WIDTH + i], f"{name}{i}", digits=9)
            for p, name in enumerate(model.POOLS)
            for i in range(FRAME_WIDTH)
        ],
    )


# --- corpus E -------------------------------------------------------------------------------------

E_CONFIG = corpora.WindowConfig(size=9, stride=4)
# sequences, statistics, windows and normalised cells of each modality, short sequences dropped
E_SQL = f"""{trimmed_sql()}, {SUBJECTS_SQL},
long_enough AS (
  SELECT l.subject_id, l.modality, l.len FROM lens l JOIN subjects s ON s.subject_id = l.subject_id WHERE len >= 15),
seq AS (
  SELECT t.subject_id, t.modality, t.sec, t.f0, t.f1, t.valid, s.fold, s.label_binary, s.phq
  FROM trimmed t JOIN long_enough l ON l.subject_id = t.subject_id AND l.modality = t.modality
  JOIN subjects s ON s.subject_id = t.subject_id),
stats AS (
  SELECT modality, avg(f0) AS m0, sqrt(greatest(var_pop(f0), 1e-8)) AS s0,
         avg(f1) AS m1, sqrt(greatest(var_pop(f1), 1e-8)) AS s1
  FROM seq WHERE fold = 'train' AND valid GROUP BY modality),
{starts_sql(9, 4, 'long_enough')},
ratios AS (
  SELECT w.subject_id, w.modality, w.start, w.win_len,
         count(CASE WHEN q.valid THEN 1 END)::DOUBLE / w.win_len::DOUBLE AS valid_ratio
  FROM starts w LEFT JOIN seq q ON q.subject_id = w.subject_id AND q.modality = w.modality
   AND q.sec >= w.start AND q.sec < w.start + w.win_len
  GROUP BY w.subject_id, w.modality, w.start, w.win_len),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY subject_id, modality ORDER BY start) - 1 AS window_idx
  FROM ratios WHERE valid_ratio >= 0.5),
cells AS (SELECT *, unnest(range(0, 9)) AS row FROM kept),
items AS (
  SELECT c.subject_id, c.modality, c.window_idx, c.row, c.valid_ratio, s.label_binary, s.phq, s.fold,
         CASE WHEN c.row < c.win_len THEN (coalesce(q.f0, 0) - m0) / s0 ELSE 0 END AS z0,
         CASE WHEN c.row < c.win_len THEN (coalesce(q.f1, 0) - m1) / s1 ELSE 0 END AS z1
  FROM cells c JOIN stats USING (modality) JOIN subjects s ON s.subject_id = c.subject_id
  LEFT JOIN seq q ON q.subject_id = c.subject_id AND q.modality = c.modality AND q.sec = c.start + c.row)"""


def e_frames(spark, sf_dir):
    everything = frames(spark, sf_dir)
    return {
        m: everything.where(F.col("modality") == m).drop("modality") for m in corpora.MODALITIES
    }


E_WIDTHS = {m: FRAME_WIDTH for m in corpora.MODALITIES}


def e_items(spark, sf_dir, modality, config=E_CONFIG):
    labelled = subjects(spark, sf_dir)
    prepared = corpora.prepare_e(
        e_frames(spark, sf_dir), E_WIDTHS, labelled, modality, config
    )
    return prepared, corpora.window_items(prepared, labelled, "edaic", config)


@query(
    "corpus_e_windows",
    f"""{E_SQL}
SELECT subject_id, modality, window_idx, row, fold, label_binary::BIGINT AS label_binary,
       phq::DOUBLE AS label_phq, round(valid_ratio, 8) AS quality_score, round(z0, 6) AS z0, round(z1, 6) AS z1
FROM items""",
)
def corpus_e_windows(spark, sf_dir):
    def rows_of(modality):
        _, items = e_items(spark, sf_dir, modality)
        return items.select(
            "subject_id",
            F.lit(modality).alias("modality"),
            "window_idx",
            "fold",
            long("label_binary"),
            "label_phq",
            r8("quality_score"),
            F.posexplode(modality).alias("row", "z"),
        )

    rows = rows_of("visual").unionByName(rows_of("acoustic"))
    return rows.select(
        *[c for c in rows.columns if c not in ("row", "z")],
        long("row"),
        *[r8(F.col("z")[i], f"z{i}", digits=6) for i in range(FRAME_WIDTH)],
    )


BOTH_SQL = f"""{trimmed_sql().split('bounds AS')[0]}
{SUBJECTS_SQL},
both_lens AS (SELECT subject_id, modality, max(sec) + 1 AS len FROM resampled GROUP BY subject_id, modality),
common AS (SELECT subject_id, min(len) AS len FROM both_lens GROUP BY subject_id HAVING count(*) = 2),
joined AS (
  SELECT r.subject_id, r.sec,
         coalesce(max(CASE WHEN modality = 'visual' THEN f0 END), 0) AS v0,
         coalesce(max(CASE WHEN modality = 'visual' THEN f1 END), 0) AS v1,
         coalesce(max(CASE WHEN modality = 'acoustic' THEN f0 END), 0) AS a0,
         coalesce(max(CASE WHEN modality = 'acoustic' THEN f1 END), 0) AS a1,
         coalesce(bool_or(CASE WHEN modality = 'visual' THEN valid END), FALSE)
         AND coalesce(bool_or(CASE WHEN modality = 'acoustic' THEN valid END), FALSE) AS valid
  FROM resampled r JOIN common c ON c.subject_id = r.subject_id AND r.sec < c.len GROUP BY r.subject_id, r.sec),
both_bounds AS (
  SELECT subject_id, min(sec) AS lo, max(sec) AS hi FROM joined WHERE valid GROUP BY subject_id
  HAVING max(sec) - min(sec) + 1 >= 15),
seq AS (
  SELECT j.subject_id, j.sec - lo AS sec, v0, v1, a0, a1, valid, s.fold
  FROM joined j JOIN both_bounds b ON b.subject_id = j.subject_id AND j.sec BETWEEN lo AND hi
  JOIN subjects s ON s.subject_id = j.subject_id),
stats AS (
  SELECT {', '.join(f'avg({c}) AS m_{c}, sqrt(greatest(var_pop({c}), 1e-8)) AS s_{c}' for c in ('v0', 'v1', 'a0', 'a1'))}
  FROM seq WHERE fold = 'train' AND valid),
seq_lens AS (SELECT subject_id, 'both' AS modality, hi - lo + 1 AS len FROM both_bounds
             WHERE subject_id IN (SELECT subject_id FROM subjects)),
{starts_sql(9, 4, 'seq_lens')},
kept AS (
  SELECT w.subject_id, w.start, w.win_len FROM starts w LEFT JOIN seq q ON q.subject_id = w.subject_id
   AND q.sec >= w.start AND q.sec < w.start + w.win_len
  GROUP BY w.subject_id, w.start, w.win_len
  HAVING count(CASE WHEN q.valid THEN 1 END)::DOUBLE / w.win_len::DOUBLE >= 0.3),
cells AS (SELECT *, unnest(range(0, win_len)) AS row FROM kept),
scaled AS (
  SELECT c.subject_id, c.start,
         {', '.join(f'(coalesce({c}, 0) - m_{c}) / s_{c} AS {c}' for c in ('v0', 'v1', 'a0', 'a1'))}
  FROM cells c CROSS JOIN stats LEFT JOIN seq q ON q.subject_id = c.subject_id AND q.sec = c.start + c.row),
-- rows of zeros in a modality are left out of its pools
pooled AS (
  SELECT subject_id, start, {', '.join(
      f"coalesce({fn}({m}{i}) FILTER ({m}0 <> 0 OR {m}1 <> 0), 0) AS {m}_{name}{i}"
      for m in 'va'
      for name, fn in (('mean', 'avg'), ('std', 'stddev_pop'), ('min', 'min'), ('max', 'max'))
      for i in range(2))}
  FROM scaled GROUP BY subject_id, start)"""
BOTH_CONFIG = corpora.WindowConfig(size=9, stride=4, min_valid_ratio=0.3)


POOLED = [f"{pool}{i}" for pool in model.POOLS for i in range(FRAME_WIDTH)]
FUSED = {
    "gated_sum": "({v} + {a}) / 2",
    "distance": "abs({v} - {a})",
    "product": "{v} * {a}",
    "gated_visual": "{v} / 2",
    "gated_acoustic": "{a} / 2",
}


@query(
    "ml_fuse_modalities",
    f"""{BOTH_SQL}
SELECT subject_id, start, {', '.join(
    f"round({formula.format(v=f'v_{p}', a=f'a_{p}')}, 6) AS {name}_{p}"
    for name, formula in FUSED.items()
    for p in POOLED)}
FROM pooled""",
)
def ml_fuse_modalities(spark, sf_dir):
    prepared, items = e_items(spark, sf_dir, "both", BOTH_CONFIG)
    fused = corpora.pooled_windows(items, prepared.widths)
    names = [f"{name}_{p}" for name in FUSED for p in POOLED]
    return fused.select(
        "subject_id",
        "start",
        *[r8(F.col("features")[i], name, digits=6) for i, name in enumerate(names)],
    )


# --- corpus D -------------------------------------------------------------------------------------

# Half of the dimensions for each modality; what is shorter than five frames is dropped after the
# statistics.
HALF = VECTOR_WIDTH // 2
D_WIDTHS = {m: HALF for m in corpora.MODALITIES}
D_CONFIG = corpora.WindowConfig(size=4, stride=3, min_len=5)


def d_frames(spark, sf_dir):
    rows = vector_frames(spark, sf_dir)
    return {
        "visual": rows.withColumn("features", F.slice("features", 1, HALF)),
        "acoustic": rows.withColumn("features", F.slice("features", HALF + 1, HALF)),
    }


def vector_labels(spark, sf_dir):
    """One label row per vector sequence."""
    return vector_frames(spark, sf_dir).select(
        "subject_id", "fold", F.col("label").alias("label_binary")
    ).distinct()


D_SQL = f"""WITH {VECTOR_FRAMES_SQL},
cells AS (
  SELECT subject_id, sec, fold, label, unnest(range(0, {HALF})) AS dim,
         unnest(features[1:{HALF}])::DOUBLE AS v, unnest(features[{HALF + 1}:{VECTOR_WIDTH}])::DOUBLE AS a
  FROM vector_frames),
stats AS (
  SELECT dim, avg(v) AS mv, sqrt(greatest(var_pop(v), 1e-8)) AS sv, avg(a) AS ma,
         sqrt(greatest(var_pop(a), 1e-8)) AS sa FROM cells WHERE fold = 'train' GROUP BY dim),
d_lens AS (
  SELECT subject_id, 'both' AS modality, max(sec) + 1 AS len FROM vector_frames GROUP BY subject_id HAVING len >= 5),
{starts_sql(4, 3, 'd_lens')},
numbered AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY start) - 1 AS window_idx FROM starts)"""


@query(
    "corpus_d_windows",
    f"""{D_SQL}
SELECT w.subject_id, w.window_idx::BIGINT AS window_idx, c.sec - w.start AS row, c.dim::BIGINT AS dim,
       c.label::BIGINT AS label_binary, c.fold, round((v - mv) / sv, 5) AS visual,
       round((a - ma) / sa, 5) AS acoustic
FROM numbered w JOIN cells c ON c.subject_id = w.subject_id AND c.sec >= w.start AND c.sec < w.start + w.win_len
JOIN stats s ON s.dim = c.dim""",
)
def corpus_d_windows(spark, sf_dir):
    labelled = vector_labels(spark, sf_dir)
    prepared = corpora.prepare_d(d_frames(spark, sf_dir), D_WIDTHS, labelled, D_CONFIG)
    items = corpora.window_items(prepared, labelled, "dvlog", D_CONFIG, check_validity=False)
    rows = items.select(
        "subject_id",
        "window_idx",
        long("label_binary"),
        "fold",
        F.posexplode(F.arrays_zip("visual", "acoustic")).alias("row", "m"),
    )
    cells = rows.select(
        "subject_id", "window_idx", "label_binary", "fold", long("row"),
        F.posexplode(F.arrays_zip("m.visual", "m.acoustic")).alias("dim", "c"),
    )
    return cells.select(
        "subject_id", "window_idx", "label_binary", "fold", "row", long("dim"),
        r8(F.col("c.visual"), "visual", digits=5), r8(F.col("c.acoustic"), "acoustic", digits=5),
    )


# --- training -------------------------------------------------------------------------------------


def vector_windows(spark, sf_dir, config):
    """Pooled windows of the vector sequences, normalised by the source the configuration names."""
    labelled = vector_labels(spark, sf_dir)
    rows = vector_frames(spark, sf_dir)
    shape = corpora.WindowConfig(size=config["window_size"], stride=config["stride"], min_len=2)
    both = {
        "visual": rows.withColumn("features", F.slice("features", 1, VECTOR_WIDTH // 2)),
        "acoustic": rows.withColumn(
            "features", F.slice("features", VECTOR_WIDTH // 2 + 1, VECTOR_WIDTH // 2)
        ),
    }
    widths = {m: VECTOR_WIDTH // 2 for m in corpora.MODALITIES}
    provided = None
    if config.get("normalization_source") == "provided":
        # the shipped statistics: over every fold
        provided = corpora.train_stats(
            rows.withColumns(
                {
                    "visual": F.slice("features", 1, VECTOR_WIDTH // 2),
                    "acoustic": F.slice("features", VECTOR_WIDTH // 2 + 1, VECTOR_WIDTH // 2),
                }
            ),
            widths,
            False,
            None,
        )
    prepared = corpora.prepare_d(both, widths, labelled, shape, provided)
    items = corpora.window_items(prepared, labelled, "dvlog", shape, check_validity=False)
    return corpora.pooled_windows(items, widths)


BASE = {"window_size": 5, "stride": 2, "normalization_source": "train", "max_iter": 10}


@query("ml_train_score")
def ml_train_score(spark, sf_dir):
    windows = checkpointed(vector_windows(spark, sf_dir, BASE))
    key = F.concat_ws("-", "subject_id", "window_idx")
    scored = model.train_and_score(windows, model.TrainConfig(max_iter=10), 7, key=key)
    renamed = scored.withColumnRenamed("label_binary", "label")
    subject_scores = aggregate.to_subjects(renamed, "mean", by=["fold"])
    return metrics.classification_metrics(subject_scores, ["fold"])


def suite(spark, sf_dir):
    return search.Suite(
        track="dvlog_both",
        dataset="dvlog",
        windows=lambda config: vector_windows(spark, sf_dir, config),
        base=BASE,
        window_sizes=(3, 5),
        policies=(
            search.Candidate("bce_balanced", {"balanced_sampling": True}),
            search.Candidate("bce_weighted", {"balanced_sampling": False, "use_pos_weight": True}),
            search.Candidate("focal", {"balanced_sampling": True, "loss_name": "focal"}),
        ),
        capacities=(
            search.Candidate("reg_0.01", {"reg_param": 0.01}),
            search.Candidate("reg_0.10", {"reg_param": 0.1}),
        ),
        normalisations=("train", "provided"),
        dev_seeds=(7, 17),
        final_seeds=(7, 17, 27),
    )


def new_store(spark):
    return Store(spark, register(new_shared_path(spark, "search")))


@query("ml_sweep")
def ml_sweep(spark, sf_dir):
    store = new_store(spark)
    search.staged_search(suite(spark, sf_dir), store)
    return search.load_ledger(store, "dvlog_both").to_df(spark)


@query("ml_finalize")
def ml_finalize(spark, sf_dir):
    """The locked run, from the stored ledger of the search over the same tables."""
    store, tried = new_store(spark), suite(spark, sf_dir)
    search.staged_search(tried, store)
    return search.finalize(tried, search.load_ledger(store, "dvlog_both"), store)
