"""Sampling, losses, configuration, seed summaries, selection and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import long, query, r8
from catalog.tables import (
    SCORE_SQL,
    WINDOW_PREDICTIONS_SQL,
    fold_by,
    fold_sql,
    table,
    window_predictions,
)
from seqloom.functions import losses, randomness
from seqloom.operators import aggregate, audit, metrics, sampling, selection
from seqloom.session import checkpointed, new_shared_path
from seqloom.sources import readers, writers

W = f"WITH {WINDOW_PREDICTIONS_SQL}"


def _key():
    return F.concat_ws("-", "subject_id", "window_idx")


# --- balance --------------------------------------------------------------------------------------


@query(
    "agg_class_weight",
    f"""{W}, c AS (SELECT label, count(*) AS class_count FROM window_predictions GROUP BY label)
SELECT subject_id, window_idx::BIGINT AS window_idx, w.label::BIGINT AS label, class_count,
       round(1.0::DOUBLE / class_count, 12) AS weight
FROM window_predictions w JOIN c ON c.label = w.label""",
)
def agg_class_weight(spark, sf_dir):
    weighted = sampling.class_weights(window_predictions(spark, sf_dir), "label")
    return weighted.select(
        "subject_id", long("window_idx"), long("label"), "class_count", r8("weight", digits=12)
    )


@query(
    "agg_pos_weight",
    f"""{W} SELECT sum(label)::BIGINT AS positives, sum(1 - label)::BIGINT AS negatives,
       round(greatest(sum(1 - label), 1) / greatest(sum(label), 1), 8) AS pos_weight
FROM window_predictions""",
)
def agg_pos_weight(spark, sf_dir):
    return sampling.pos_weight(window_predictions(spark, sf_dir), "label").select(
        "positives", "negatives", r8("pos_weight")
    )


@query(
    "agg_window_label_dist",
    f"""{W}, f AS (SELECT *, {fold_sql('(subject_id::BIGINT)')} AS fold FROM window_predictions)
SELECT fold, count(*) AS windows, sum(label)::BIGINT AS windows_positive,
       count(DISTINCT subject_id) AS subjects,
       count(DISTINCT CASE WHEN label = 1 THEN subject_id END) AS subjects_positive
FROM f GROUP BY fold""",
)
def agg_window_label_dist(spark, sf_dir):
    folded = window_predictions(spark, sf_dir).withColumn(
        "fold", fold_by(F.col("subject_id").cast("long"))
    )
    return audit.window_label_distribution(folded, label="label")


UNIFORM_SQL = """('0x' || substr(md5(subject_id || '-' || window_idx || ':' || {seed}), 1, 13))::BIGINT
       / 4503599627370496.0::DOUBLE"""


@query(
    "smp_seeded_uniform",
    f"""{W} SELECT subject_id, window_idx::BIGINT AS window_idx,
       round({UNIFORM_SQL.format(seed=17)}, 10) AS u FROM window_predictions""",
)
def smp_seeded_uniform(spark, sf_dir):
    return window_predictions(spark, sf_dir).select(
        "subject_id", long("window_idx"), r8(randomness.hash_uniform(_key(), 17), "u", digits=10)
    )


@query(
    "smp_weighted",
    f"""{W}, c AS (SELECT label, count(*) AS n FROM window_predictions GROUP BY label),
rates AS (
  SELECT label, (SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n)::DOUBLE AS rate FROM c),
drawn AS (
  SELECT subject_id, window_idx, w.label,
         floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT AS times
  FROM (SELECT *, {UNIFORM_SQL.format(seed=7)} AS u FROM window_predictions) w
  JOIN rates USING (label))
SELECT subject_id, window_idx::BIGINT AS window_idx, label::BIGINT AS label,
       unnest(range(1, times + 1)) AS "copy" FROM drawn""",
)
def smp_weighted(spark, sf_dir):
    drawn = sampling.weighted_resample(window_predictions(spark, sf_dir), _key(), 7, "label")
    return drawn.select("subject_id", long("window_idx"), long("label"), long("copy"))


@query(
    "smp_stratified",
    f"""{W}, c AS (SELECT label, count(*) AS n FROM window_predictions GROUP BY label)
SELECT subject_id, window_idx::BIGINT AS window_idx, w.label::BIGINT AS label
FROM window_predictions w JOIN c ON c.label = w.label
WHERE {UNIFORM_SQL.format(seed=27)} < (SELECT min(n) FROM c)::DOUBLE / c.n::DOUBLE""",
)
def smp_stratified(spark, sf_dir):
    kept = sampling.stratified_sample(
        window_predictions(spark, sf_dir), _key(), 27, "label"
    )
    return kept.select("subject_id", long("window_idx"), long("label"))


# --- losses ---------------------------------------------------------------------------------------

# a logit per window
LOGIT_SQL = "(window_probability * 50.0::DOUBLE - 25.0::DOUBLE) / 10.0::DOUBLE"
BCE_SQL = f"""(greatest({LOGIT_SQL}, 0) - {LOGIT_SQL} * label + ln(1 + exp(-abs({LOGIT_SQL}))))"""


def logits(spark, sf_dir):
    return window_predictions(spark, sf_dir).withColumn(
        "logit", (F.col("window_probability") * 50.0 - 25.0) / 10.0
    )


@query(
    "fn_bce_loss",
    f"""{W} SELECT round(avg({BCE_SQL}), 8) AS loss,
       round(avg(CASE WHEN label = 1 THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END * {BCE_SQL}), 8) AS weighted_loss
FROM window_predictions""",
)
def fn_bce_loss(spark, sf_dir):
    z, y = F.col("logit"), F.col("label")
    return logits(spark, sf_dir).agg(
        r8(F.avg(losses.window_loss("bce", z, y)), "loss"),
        r8(F.avg(losses.window_loss("bce", z, y, pos_weight=2.5)), "weighted_loss"),
    )


@query(
    "fn_focal_loss",
    f"""{W}, p AS (
  SELECT label, {BCE_SQL} AS bce, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({LOGIT_SQL}))) AS s FROM window_predictions)
SELECT label::BIGINT AS label, round(avg(CASE WHEN label = 1 THEN 0.75::DOUBLE * (1 - s) * (1 - s)
       ELSE 0.25::DOUBLE * s * s END * bce), 8) AS loss FROM p GROUP BY label""",
)
def fn_focal_loss(spark, sf_dir):
    loss = losses.window_loss("focal", F.col("logit"), F.col("label"))
    return logits(spark, sf_dir).groupBy(long("label")).agg(r8(F.avg(loss), "loss"))


@query(
    "agg_epoch_loss",
    f"""{W}, b AS (
  SELECT epoch, seed, window_idx, count(*) AS items, avg({BCE_SQL}) AS loss FROM window_predictions
  GROUP BY epoch, seed, window_idx)
SELECT epoch, round(sum(loss * items) / sum(items), 8) AS train_loss FROM b GROUP BY epoch""",
)
def agg_epoch_loss(spark, sf_dir):
    loss = losses.window_loss("bce", F.col("logit"), F.col("label"))
    batches = logits(spark, sf_dir).groupBy("epoch", "seed", "window_idx").agg(
        F.count(F.lit(1)).alias("items"), F.avg(loss).alias("loss")
    )
    return selection.epoch_loss(batches, ["epoch"]).select("epoch", r8("train_loss"))


# --- experiment records ---------------------------------------------------------------------------


def runs(spark, sf_dir, extra=(), methods=aggregate.METHODS):
    """One metrics row per (track, candidate, seed, method)."""
    by = ["track", "candidate", "seed", *extra]
    scored = aggregate.to_subjects_all(window_predictions(spark, sf_dir), methods, by=by)
    return metrics.with_scores(metrics.confusion(scored, [*by, "method"]))


def runs_sql(extra=""):
    keys = "track, candidate, seed" + extra
    return f"""{W}, scored AS (
  SELECT {keys}, subject_id, min(label) AS label, {SCORE_SQL['mean']} AS p_mean,
         {SCORE_SQL['topk']} AS p_topk, {SCORE_SQL['attention']} AS p_attention
  FROM window_predictions GROUP BY {keys}, subject_id),
per_method AS (
  SELECT {keys}, 'mean' AS method, label, p_mean AS p FROM scored
  UNION ALL SELECT {keys}, 'topk', label, p_topk FROM scored
  UNION ALL SELECT {keys}, 'attention', label, p_attention FROM scored),
cells AS (
  SELECT {keys}, method,
         sum(CASE WHEN label = 0 AND p < 0.5 THEN 1 ELSE 0 END)::DOUBLE AS tn,
         sum(CASE WHEN label = 0 AND p >= 0.5 THEN 1 ELSE 0 END)::DOUBLE AS fp,
         sum(CASE WHEN label = 1 AND p < 0.5 THEN 1 ELSE 0 END)::DOUBLE AS fn,
         sum(CASE WHEN label = 1 AND p >= 0.5 THEN 1 ELSE 0 END)::DOUBLE AS tp
  FROM per_method GROUP BY {keys}, method),
parts AS (
  SELECT *, CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END AS f0,
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
         CASE WHEN 2 * tn + fp + fn > 0 THEN 1 ELSE 0 END
         + CASE WHEN 2 * tp + fp + fn > 0 THEN 1 ELSE 0 END AS classes
  FROM cells),
runs AS (
  SELECT *, (f0 + f1) / classes AS macro_f1,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM parts)"""


@query(
    "agg_seed_summary",
    f"""{runs_sql()}
SELECT track, candidate, method, count(*) AS num_seeds, round(avg(macro_f1), 8) AS macro_f1_mean,
       round(stddev_pop(macro_f1), 8) AS macro_f1_std,
       round(avg(CASE WHEN seed <> 2 THEN recall END), 8) AS recall_mean,
       round(stddev_pop(CASE WHEN seed <> 2 THEN recall END), 8) AS recall_std
FROM runs GROUP BY track, candidate, method""",
)
def agg_seed_summary(spark, sf_dir):
    # the recall of one seed is made NaN and must be left out
    spoiled = runs(spark, sf_dir).withColumn(
        "recall", F.when(F.col("seed") == 2, F.lit(float("nan"))).otherwise(F.col("recall"))
    )
    summary = selection.seed_summary(
        spoiled, ["track", "candidate", "method"], ["macro_f1", "recall"]
    )
    return summary.select(
        "track",
        "candidate",
        "method",
        "num_seeds",
        *[r8(f"{m}_{s}") for m in ("macro_f1", "recall") for s in ("mean", "std")],
    )


SELECTED_SQL = """means AS (
  SELECT track, candidate, method, avg(macro_f1) AS m,
         CASE method WHEN 'mean' THEN 1 WHEN 'topk' THEN 2 ELSE 3 END AS position
  FROM runs GROUP BY track, candidate, method),
selected AS (
  SELECT track, candidate, method AS selected_aggregation, m AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY track, candidate ORDER BY round(m, 12) DESC, position) AS r FROM means)
  WHERE r = 1)"""


@query(
    "agg_select_method",
    f"""{runs_sql()}, {SELECTED_SQL}
SELECT track, candidate, selected_aggregation, round(score, 8) AS score FROM selected""",
)
def agg_select_method(spark, sf_dir):
    return select_methods(runs(spark, sf_dir)).select(
        "track", "candidate", "selected_aggregation", r8("score")
    )


def select_methods(records):
    return selection.select_method(records, ["track", "candidate"], aggregate.METHODS)


# Fixed values of the test data: the candidates in listed order.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(
    "top_stage_choice",
    f"""{runs_sql()}, {SELECTED_SQL}
SELECT track, candidate, round(score, 8) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY track ORDER BY round(score, 12) DESC, candidate) AS r FROM selected)
WHERE r = 1""",
)
def top_stage_choice(spark, sf_dir):
    best = select_methods(runs(spark, sf_dir)).withColumn(
        "position", selection.position_of(F.col("candidate"), PRIORITIES)
    )
    return selection.select_candidate(best, ["track"], score="score").select(
        "track", "candidate", r8("score")
    )


# Boards: seeds 0-2 play the dev fold, the others the test fold.
BOARD_SQL = f"""{runs_sql()}, board AS (
  SELECT CASE WHEN candidate < '3' THEN 'stage_a' ELSE 'stage_b' END AS stage, track,
         CASE WHEN track IN ('track_0', 'track_1') THEN 'dvlog' ELSE 'edaic' END AS dataset,
         CASE WHEN track IN ('track_0', 'track_2') THEN 'acoustic' ELSE 'visual' END AS modality,
         candidate,
         CASE WHEN candidate < '4' THEN 'train' ELSE 'provided' END AS normalization_source,
         avg(CASE WHEN seed <= 2 THEN macro_f1 END) AS dev_macro_f1_mean,
         stddev_pop(CASE WHEN seed <= 2 THEN macro_f1 END) AS dev_macro_f1_std,
         avg(CASE WHEN seed > 2 THEN macro_f1 END) AS test_macro_f1_mean,
         stddev_pop(CASE WHEN seed > 2 THEN macro_f1 END) AS test_macro_f1_std
  FROM runs WHERE method = 'mean' GROUP BY track, candidate)"""
F1_COLUMNS = [f"{f}_macro_f1_{s}" for f in ("dev", "test") for s in ("mean", "std")]
F1_ROUND_SQL = ", ".join(f"round({c}, 8) AS {c}" for c in F1_COLUMNS)


def board(spark, sf_dir):
    score = {
        "dev": F.when(F.col("seed") <= 2, F.col("macro_f1")),
        "test": F.when(F.col("seed") > 2, F.col("macro_f1")),
    }
    first = F.col("track").isin("track_0", "track_1")
    acoustic = F.col("track").isin("track_0", "track_2")
    return (
        runs(spark, sf_dir, methods=["mean"])
        .withColumns({f"{fold}_macro_f1": c for fold, c in score.items()})
        .groupBy("track", "candidate")
        .agg(
            *[
                fn(f"{fold}_macro_f1").alias(f"{fold}_macro_f1_{name}")
                for fold in score
                for name, fn in (("mean", F.avg), ("std", F.stddev_pop))
            ]
        )
        .withColumns(
            {
                "stage": F.when(F.col("candidate") < "3", "stage_a").otherwise("stage_b"),
                "dataset": F.when(first, "dvlog").otherwise("edaic"),
                "modality": F.when(acoustic, "acoustic").otherwise("visual"),
                "normalization_source": F.when(F.col("candidate") < "4", "train").otherwise(
                    "provided"
                ),
            }
        )
    )


@query(
    "sort_leaderboard",
    f"""{BOARD_SQL} SELECT stage, dataset, modality, track, candidate, {F1_ROUND_SQL} FROM board
ORDER BY stage, dataset, modality, dev_macro_f1_mean DESC, track, candidate""",
)
def sort_leaderboard(spark, sf_dir):
    return selection.leaderboard(board(spark, sf_dir)).select(
        "stage", "dataset", "modality", "track", "candidate", *[r8(c) for c in F1_COLUMNS]
    )


# Of all candidates of a track, the one that is best on the dev fold is run for good.
FINAL_SQL = f"""{BOARD_SQL}, final AS (
  SELECT * FROM board
  QUALIFY row_number() OVER (PARTITION BY track ORDER BY round(dev_macro_f1_mean, 12) DESC, candidate) = 1)"""


def final_rows(spark, sf_dir):
    rows = checkpointed(board(spark, sf_dir)).withColumns(
        {
            "position": selection.position_of(F.col("candidate"), PRIORITIES),
            "dev_score": F.round("dev_macro_f1_mean", 12),
        }
    )
    best = selection.select_candidate(rows, ["track"], score="dev_score")
    return rows.join(best.select("track", "candidate"), ["track", "candidate"], "left_semi")


@query(
    "sort_final",
    f"""{FINAL_SQL} SELECT dataset, modality, track, candidate, {F1_ROUND_SQL} FROM final
ORDER BY dataset, test_macro_f1_mean DESC, track""",
)
def sort_final(spark, sf_dir):
    return selection.final_order(final_rows(spark, sf_dir)).select(
        "dataset", "modality", "track", "candidate", *[r8(c) for c in F1_COLUMNS]
    )


@query(
    "win_modality_rank",
    f"""{FINAL_SQL} SELECT dataset, modality, round(test_macro_f1_mean, 8) AS test_macro_f1_mean,
       row_number() OVER (PARTITION BY dataset ORDER BY test_macro_f1_mean DESC, track) AS rank FROM final""",
)
def win_modality_rank(spark, sf_dir):
    return selection.modality_ranking(final_rows(spark, sf_dir)).select(
        "dataset", "modality", r8("test_macro_f1_mean"), long("rank")
    )


@query(
    "agg_modality_norms",
    f"""{BOARD_SQL} SELECT dataset, array_to_string(list_sort(list(DISTINCT normalization_source)), ', ') AS sources
FROM board GROUP BY dataset""",
)
def agg_modality_norms(spark, sf_dir):
    return selection.normalisation_sources(board(spark, sf_dir))


@query(
    "sink_leaderboard",
    f"""{BOARD_SQL}, ordered AS (
  SELECT *, row_number() OVER (ORDER BY stage, dataset, modality, dev_macro_f1_mean DESC, track, candidate) AS position
  FROM board)
SELECT position, stage, track, candidate, round(dev_macro_f1_mean, 8) AS dev_macro_f1_mean FROM ordered""",
)
def sink_leaderboard(spark, sf_dir):
    path = new_shared_path(spark, "leaderboard")
    rows = selection.leaderboard(board(spark, sf_dir)).select(
        "stage", "track", "candidate", "dev_macro_f1_mean"
    )
    writers.write_leaderboard(rows, path)
    schema = "stage string, track string, candidate string, dev_macro_f1_mean double"
    back = spark.read.csv(path, header=True, schema=schema)
    # one file, so the id counts its lines
    return back.select(
        (F.monotonically_increasing_id() + 1).alias("position"),
        "stage",
        "track",
        "candidate",
        r8("dev_macro_f1_mean"),
    )




@query(
    "sink_report",
    f"""{FINAL_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY test_macro_f1_mean DESC, track) AS rank FROM final)
SELECT '| ' || dataset || ' | ' || modality || ' | ' || rank || ' | ' || printf('%.4f +/- %.4f',
       test_macro_f1_mean, test_macro_f1_std) || ' |' AS line FROM ranked""",
)
def sink_report(spark, sf_dir):
    path = new_shared_path(spark, "report")
    score = F.format_string("%.4f +/- %.4f", "test_macro_f1_mean", "test_macro_f1_std")
    rows = selection.modality_ranking(final_rows(spark, sf_dir)).withColumns(
        {"score": score, "position": F.concat_ws("-", "dataset", F.col("rank").cast("string"))}
    )
    lines = writers.report_lines(rows, ["dataset", "modality", "rank", "score"])
    writers.write_lines(lines, ["position"], path)
    return spark.read.text(path).withColumnRenamed("value", "line")


# --- configuration --------------------------------------------------------------------------------


@query(
    "prj_stride",
    """SELECT o_orderkey, greatest(1, (o_custkey % 31) // 2)::BIGINT AS half_window, 15::BIGINT AS fixed_15
FROM orders""",
)
def prj_stride(spark, sf_dir):
    size = F.col("o_custkey") % 31
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        *[long(selection.stride_for(size, p), p) for p in selection.STRIDE_POLICIES],
    )


@query(
    "prj_config_merge",
    """SELECT o_orderkey, CASE WHEN o_orderpriority < '3' THEN 'focal' ELSE 'bce' END AS loss_name,
       CASE WHEN o_orderstatus = 'O' THEN 128 ELSE 64 END::BIGINT AS hidden_dim, 9::BIGINT AS window_size
FROM orders""",
)
def prj_config_merge(spark, sf_dir):
    nothing = F.lit(None)
    base = F.struct(
        F.lit("bce").alias("loss_name"), F.lit(64).alias("hidden_dim"), F.lit(9).alias("window_size")
    )
    override = F.struct(
        F.when(F.col("o_orderpriority") < "3", F.lit("focal")).alias("loss_name"),
        F.when(F.col("o_orderstatus") == "O", F.lit(128)).alias("hidden_dim"),
        nothing.cast("int").alias("window_size"),
    )
    configs = table(spark, sf_dir, "orders").select(
        "o_orderkey", base.alias("base"), override.alias("override")
    )
    merged = configs.select(
        "o_orderkey",
        *selection.merged_columns(["loss_name", "hidden_dim", "window_size"], "base", "override"),
    )
    return merged.select("o_orderkey", "loss_name", long("hidden_dim"), long("window_size"))


# --- history and summaries ------------------------------------------------------------------------


@query(
    "win_best_epoch",
    f"""{runs_sql(", epoch")}, history AS (
  SELECT track, candidate, seed, epoch, macro_f1 AS score FROM runs WHERE method = 'mean'),
gains AS (
  SELECT *, coalesce(score > max(score) OVER (PARTITION BY track, candidate, seed ORDER BY epoch
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS gain,
         row_number() OVER (PARTITION BY track, candidate, seed ORDER BY epoch) AS n FROM history),
misses AS (
  SELECT *, n - max(CASE WHEN gain THEN n END) OVER (PARTITION BY track, candidate, seed ORDER BY epoch) AS miss
  FROM gains),
stops AS (
  SELECT track, candidate, seed, coalesce(min(CASE WHEN miss >= 2 THEN epoch END), max(epoch)) AS stopped_epoch
  FROM misses GROUP BY track, candidate, seed)
SELECT m.track, m.candidate, m.seed, max(CASE WHEN gain THEN epoch END) AS best_epoch,
       round(max(score), 8) AS best_score, stopped_epoch
FROM misses m JOIN stops s ON s.track = m.track AND s.candidate = m.candidate AND s.seed = m.seed
  AND epoch <= stopped_epoch
GROUP BY m.track, m.candidate, m.seed, stopped_epoch""",
)
def win_best_epoch(spark, sf_dir):
    history = (
        runs(spark, sf_dir, ["epoch"])
        .where(F.col("method") == "mean")
        .select("track", "candidate", "seed", "epoch", F.col("macro_f1").alias("dev_macro_f1"))
    )
    best = selection.best_epoch(history, ["track", "candidate", "seed"], patience=2)
    return best.select("track", "candidate", "seed", "best_epoch", r8("best_score"), "stopped_epoch")


@query(
    "ml_experiment_summary",
    f"""{runs_sql()}, {SELECTED_SQL}, chosen AS (
  SELECT r.*, s.selected_aggregation FROM runs r JOIN selected s
    ON s.track = r.track AND s.candidate = r.candidate AND s.selected_aggregation = r.method),
summary AS (
  SELECT track, candidate, count(*) AS num_seeds, avg(macro_f1) AS m, stddev_pop(macro_f1) AS sd
  FROM chosen GROUP BY track, candidate)
SELECT c.track, c.candidate, c.selected_aggregation, num_seeds, round(m, 8) AS macro_f1_mean,
       round(sd, 8) AS macro_f1_std, c.seed, round(c.macro_f1, 8) AS seed_macro_f1
FROM chosen c JOIN summary s ON s.track = c.track AND s.candidate = c.candidate""",
)
def ml_experiment_summary(spark, sf_dir):
    records = checkpointed(runs(spark, sf_dir))
    summary = selection.experiment_summary(
        records, ["track", "candidate"], ["macro_f1"], select_methods(records)
    )
    return summary.withColumn("s", F.explode("seeds")).select(
        "track",
        "candidate",
        "selected_aggregation",
        "num_seeds",
        r8("macro_f1_mean"),
        r8("macro_f1_std"),
        F.col("s.seed").alias("seed"),
        r8(F.col("s.macro_f1"), "seed_macro_f1"),
    )


def write_summaries(spark, sf_dir):
    """One ``summary.json`` per experiment, each in a folder of its own."""
    root = new_shared_path(spark, "summaries")
    rows = board(spark, sf_dir)

    def block(fold, part):
        return F.struct(F.col(f"{fold}_macro_f1_{part}").alias("macro_f1"))

    document = F.to_json(
        F.struct(
            F.col("stage").alias("stage_name"),
            F.col("track").alias("suite_track"),
            "dataset",
            "modality",
            F.col("candidate").alias("candidate_name"),
            F.lit("mean").alias("selected_aggregation"),
            *[
                block(fold, part).alias(f"{fold}_metrics_{part}")
                for fold in ("dev", "test")
                for part in ("mean", "std")
            ],
        )
    )
    folder = F.concat_ws("/", "stage", "track", F.substring("candidate", 1, 1))
    writers.write_documents(
        rows.select(folder.alias("folder"), document.alias("document")), root, "summary.json"
    )
    return root


@query(
    "src_run_summaries",
    f"""{BOARD_SQL} SELECT stage AS stage_name, track AS suite_track, candidate AS candidate_name,
       stage || '/' || track || '/' || candidate[1] || '/summary.json' AS summary_path FROM board""",
)
def src_run_summaries(spark, sf_dir):
    found = readers.read_run_summaries(spark, write_summaries(spark, sf_dir))
    return found.select(
        "stage_name",
        "suite_track",
        "candidate_name",
        F.regexp_extract("summary_path", r"(stage_[^/]+/[^/]+/[^/]+/summary\.json)$", 1).alias(
            "summary_path"
        ),
    )


@query(
    "ml_leaderboard",
    f"""{BOARD_SQL} SELECT stage, dataset, modality, track, candidate, 'mean' AS selected_aggregation,
       {F1_ROUND_SQL} FROM board ORDER BY stage, dataset, modality, dev_macro_f1_mean DESC""",
)
def ml_leaderboard(spark, sf_dir):
    found = readers.read_run_summaries(spark, write_summaries(spark, sf_dir))
    return selection.leaderboard(selection.leaderboard_rows(found)).select(
        "stage",
        "dataset",
        "modality",
        "track",
        "candidate",
        "selected_aggregation",
        *[r8(c) for c in F1_COLUMNS],
    )
