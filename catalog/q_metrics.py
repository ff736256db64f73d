"""Window-to-subject aggregation, evaluation metrics, curves and error review."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import long, query, r8
from catalog.tables import (
    F4_MEAN,
    SCORE_SQL,
    WINDOW_PREDICTIONS_SQL,
    p8_sql,
    subject_predictions_sql,
    window_predictions,
)
from seqloom.operators import aggregate, errors, metrics


def mean_subjects(spark, sf_dir):
    return aggregate.to_subjects(window_predictions(spark, sf_dir), "mean")


def edge_subjects(spark, sf_dir):
    """Every window its own subject, with probabilities that lie on bin edges."""
    return window_predictions(spark, sf_dir).select(
        F.concat_ws("-", "subject_id", "window_idx").alias("subject_id"),
        "label",
        F.lit(1).alias("num_windows"),
        F.col("edge_probability").alias("probability"),
        (F.col("edge_probability") >= 0.5).cast("int").alias("prediction"),
    )


def _subject_columns(df):
    return df.select(
        "subject_id", long("label"), long("num_windows"), r8("probability"), long("prediction")
    )


for _method in aggregate.METHODS:

    def _run(spark, sf_dir, method=_method):
        return _subject_columns(aggregate.to_subjects(window_predictions(spark, sf_dir), method))

    query(
        f"agg_{_method}",
        f"""WITH {WINDOW_PREDICTIONS_SQL}, {subject_predictions_sql(_method)}
SELECT subject_id, label::BIGINT AS label, num_windows,
       {p8_sql('probability')} AS probability, prediction::BIGINT AS prediction FROM subject_predictions""",
    )(_run)


@query(
    "agg_subject_predictions",
    f"""WITH {WINDOW_PREDICTIONS_SQL}
SELECT subject_id, min(label)::BIGINT AS label, count(*) AS num_windows,
       {p8_sql(SCORE_SQL['mean'])} AS p_mean, {p8_sql(SCORE_SQL['topk'])} AS p_topk,
       {p8_sql(SCORE_SQL['attention'])} AS p_attention
FROM window_predictions GROUP BY subject_id ORDER BY subject_id""",
)
def agg_subject_predictions(spark, sf_dir):
    return (
        aggregate.subject_scores(window_predictions(spark, sf_dir))
        .select(
            "subject_id",
            long("label"),
            "num_windows",
            *[r8(m, f"p_{m}") for m in aggregate.METHODS],
        )
        .orderBy("subject_id")
    )


@query(
    "prj_threshold",
    f"""WITH {WINDOW_PREDICTIONS_SQL}
SELECT subject_id, window_idx::BIGINT AS window_idx,
       CASE WHEN window_probability >= 0.5 THEN 1 ELSE 0 END::BIGINT AS prediction
FROM window_predictions""",
)
def prj_threshold(spark, sf_dir):
    wp = window_predictions(spark, sf_dir).withColumn("probability", F.col("window_probability"))
    return aggregate.with_prediction(wp).select(
        "subject_id", long("window_idx"), long("prediction")
    )


CONFUSION_SQL = """confusion AS (
  SELECT count(*) AS num_subjects,
         sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END)::BIGINT AS tn,
         sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END)::BIGINT AS fp,
         sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END)::BIGINT AS fn,
         sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END)::BIGINT AS tp,
         avg((probability - label) * (probability - label)) AS brier_score
  FROM subject_predictions)"""


@query(
    "agg_confusion",
    f"""{F4_MEAN}, {CONFUSION_SQL}
SELECT 0::BIGINT AS true_label, tn AS pred_0, fp AS pred_1 FROM confusion
UNION ALL SELECT 1::BIGINT, fn, tp FROM confusion""",
)
def agg_confusion(spark, sf_dir):
    return metrics.confusion_long(mean_subjects(spark, sf_dir)).select(
        long("true_label"), "pred_0", "pred_1"
    )


@query(
    "agg_precision_recall",
    f"""{F4_MEAN}, {CONFUSION_SQL}
SELECT round(tp / (tp + fp), 8) AS "precision", round(tp / (tp + fn), 8) AS recall FROM confusion""",
)
def agg_precision_recall(spark, sf_dir):
    return metrics.with_scores(metrics.confusion(mean_subjects(spark, sf_dir))).select(
        r8("precision"), r8("recall")
    )


F1_SQL = """
       round((2.0 * tn / (2 * tn + fp + fn) + 2.0 * tp / (2 * tp + fp + fn)) / 2, 8) AS macro_f1,
       round((2.0 * tn / (2 * tn + fp + fn) * (tn + fp) + 2.0 * tp / (2 * tp + fp + fn) * (fn + tp))
             / num_subjects, 8) AS weighted_f1"""


@query("agg_f1", f"""{F4_MEAN}, {CONFUSION_SQL} SELECT {F1_SQL} FROM confusion""")
def agg_f1(spark, sf_dir):
    return metrics.with_scores(metrics.confusion(mean_subjects(spark, sf_dir))).select(
        r8("macro_f1"), r8("weighted_f1")
    )


@query(
    "agg_brier",
    f"""{F4_MEAN}, {CONFUSION_SQL} SELECT round(brier_score, 8) AS brier_score FROM confusion""",
)
def agg_brier(spark, sf_dir):
    return metrics.confusion(mean_subjects(spark, sf_dir)).select(r8("brier_score"))


EDGES_SQL = """edges AS (
  SELECT i AS bin_index, i * 0.1::DOUBLE AS lo,
         CASE WHEN i = 9 THEN 1.0::DOUBLE ELSE (i + 1) * 0.1::DOUBLE END AS hi
  FROM range(10) t(i)),
bins AS (
  SELECT bin_index, lo, hi, count(p.subject_id) AS n, avg(p.probability) AS conf, avg(p.label) AS acc
  FROM edges LEFT JOIN subject_predictions p
    ON p.probability >= lo AND (p.probability < hi OR (bin_index = 9 AND p.probability <= hi))
  GROUP BY bin_index, lo, hi)"""
BINS_OUT_SQL = """SELECT bin_index::BIGINT AS bin_index, round(lo, 8) AS "left", round(hi, 8) AS "right",
       n AS "count", round(conf, 8) AS mean_confidence, round(acc, 8) AS mean_accuracy FROM bins"""
F4_EDGE = f"""WITH {WINDOW_PREDICTIONS_SQL},
subject_predictions AS (
  SELECT subject_id || '-' || window_idx AS subject_id, label, edge_probability AS probability
  FROM window_predictions)"""


def _bins_out(df):
    return df.select(
        long("bin_index"),
        r8("left"),
        r8("right"),
        "count",
        r8("mean_confidence"),
        r8("mean_accuracy"),
    )


@query(
    "agg_ece",
    f"""{F4_MEAN}, {EDGES_SQL}
SELECT round(sum(abs(acc - conf) * n) / (SELECT count(*) FROM subject_predictions), 8) AS ece
FROM bins WHERE n > 0""",
)
def agg_ece(spark, sf_dir):
    return metrics.expected_calibration_error(mean_subjects(spark, sf_dir)).select(r8("ece"))


@query("agg_calibration", f"{F4_MEAN}, {EDGES_SQL} {BINS_OUT_SQL}")
def agg_calibration(spark, sf_dir):
    return _bins_out(metrics.calibration_bins(mean_subjects(spark, sf_dir)))


@query("join_bins_spine", f"{F4_EDGE}, {EDGES_SQL} {BINS_OUT_SQL}")
def join_bins_spine(spark, sf_dir):
    return _bins_out(metrics.calibration_bins(edge_subjects(spark, sf_dir)))


RANKED_SQL = """points AS (
  SELECT probability, sum(label) AS pos, sum(1 - label) AS neg
  FROM subject_predictions GROUP BY probability),
ranked AS (
  SELECT *, coalesce(sum(pos) OVER w, 0) AS tp0, coalesce(sum(neg) OVER w, 0) AS fp0,
         lead(pos) OVER o AS next_pos, lead(neg) OVER o AS next_neg,
         (SELECT sum(pos) FROM points) AS p, (SELECT sum(neg) FROM points) AS n
  FROM points
  WINDOW o AS (ORDER BY probability DESC),
         w AS (ORDER BY probability DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(
    "agg_auroc",
    f"""{F4_MEAN}, {RANKED_SQL}
SELECT round(sum(neg * (tp0 + pos / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(n)::DOUBLE), 8) AS auroc FROM ranked""",
)
def agg_auroc(spark, sf_dir):
    return metrics.ranking_scores(mean_subjects(spark, sf_dir)).select(r8("auroc"))


@query(
    "agg_average_precision",
    f"""{F4_MEAN}, {RANKED_SQL}
SELECT round(sum(pos * ((tp0 + pos)::DOUBLE / (tp0 + pos + fp0 + neg)::DOUBLE)) / max(p)::DOUBLE, 8) AS pr_auc
FROM ranked""",
)
def agg_average_precision(spark, sf_dir):
    return metrics.ranking_scores(mean_subjects(spark, sf_dir)).select(r8("pr_auc"))


@query(
    "win_roc_curve",
    f"""{F4_MEAN}, {RANKED_SQL}
SELECT 'inf' AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL
SELECT printf('%.6f', probability), round((fp0 + neg)::DOUBLE / n::DOUBLE, 8),
       round((tp0 + pos)::DOUBLE / p::DOUBLE, 8)
FROM ranked
WHERE tp0 + fp0 = 0 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg""",
)
def win_roc_curve(spark, sf_dir):
    curve = metrics.roc_curve(mean_subjects(spark, sf_dir))
    return curve.select(_threshold_text(), r8("fpr"), r8("tpr"))


def _threshold_text():
    finite = F.col("threshold") < float("inf")
    return (
        F.when(finite, F.format_string("%.6f", "threshold"))
        .when(F.col("threshold").isNotNull(), F.lit("inf"))
        .alias("threshold")
    )


@query(
    "win_pr_curve",
    f"""{F4_MEAN}, {RANKED_SQL}
SELECT NULL AS threshold, 1.0::DOUBLE AS "precision", 0.0::DOUBLE AS recall
UNION ALL
SELECT printf('%.6f', probability), round((tp0 + pos)::DOUBLE / (tp0 + pos + fp0 + neg)::DOUBLE, 8),
       round((tp0 + pos)::DOUBLE / p::DOUBLE, 8)
FROM ranked""",
)
def win_pr_curve(spark, sf_dir):
    curve = metrics.pr_curve(mean_subjects(spark, sf_dir))
    return curve.select(_threshold_text(), r8("precision"), r8("recall"))


_REVIEW_SQL = """SELECT subject_id, label::BIGINT AS label, prediction::BIGINT AS prediction,
       probability, num_windows
FROM subject_predictions WHERE {condition} ORDER BY {order}, subject_id LIMIT 10"""


def _review_out(df):
    return df.select(
        "subject_id", long("label"), long("prediction"), "probability", "num_windows"
    )


@query(
    "top_fp",
    F4_MEAN + _REVIEW_SQL.format(condition="label = 0 AND prediction = 1", order="probability DESC"),
)
def top_fp(spark, sf_dir):
    return _review_out(errors.top_false_positives(mean_subjects(spark, sf_dir)))


@query(
    "top_fn",
    F4_MEAN + _REVIEW_SQL.format(condition="label = 1 AND prediction = 0", order="probability"),
)
def top_fn(spark, sf_dir):
    return _review_out(errors.top_false_negatives(mean_subjects(spark, sf_dir)))


@query(
    "top_sparse",
    F4_MEAN
    + _REVIEW_SQL.format(
        condition="num_windows <= 2 AND prediction <> label", order="probability DESC"
    ),
)
def top_sparse(spark, sf_dir):
    return _review_out(errors.sparse_failures(mean_subjects(spark, sf_dir)))


@query(
    "agg_error_counts",
    f"""{F4_MEAN}
SELECT sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END)::BIGINT AS false_positives,
       sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END)::BIGINT AS false_negatives,
       sum(CASE WHEN num_windows <= 2 THEN 1 ELSE 0 END)::BIGINT AS sparse_subjects
FROM subject_predictions""",
)
def agg_error_counts(spark, sf_dir):
    return errors.error_counts(mean_subjects(spark, sf_dir))
