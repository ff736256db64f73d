"""Evaluation beyond one record: intervals, slices, abstaining, calibration and review documents, transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.q_metrics import CONFUSION_SQL, EDGES_SQL, mean_subjects
from catalog.registry import long, query, r8
from catalog.tables import (
    F4_MEAN,
    SUBJECTS_SQL,
    WINDOW_PREDICTIONS_SQL,
    subject_predictions_sql,
    subjects,
    table,
    window_predictions,
)
from seqloom.functions import labels as L
from seqloom.operators import aggregate, bootstrap, metrics, selective, transcripts
from seqloom.session import new_shared_path, register
from seqloom.sources import writers

# --- scores of a group, for any key list ----------------------------------------------------------

F_PARTS_SQL = """CASE WHEN 2 * tn + fp + fn > 0 THEN 2.0::DOUBLE * tn / (2 * tn + fp + fn) ELSE 0 END AS f0,
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
         (2 * tn + fp + fn > 0)::INT + (2 * tp + fp + fn > 0)::INT AS classes"""
SCORES_SQL = """CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS "precision",
         CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall,
         (f0 + f1) / classes AS macro_f1, (f0 * (tn + fp) + f1 * (fn + tp)) / (tn + fp + fn + tp) AS weighted_f1"""
BIN_SQL = "(" + " + ".join(f"(probability >= {i} * 0.1::DOUBLE)::INT" for i in range(10)) + " - 1)"


def cells_sql(weight="1"):
    return ", ".join(
        f"sum(CASE WHEN label = {y} AND prediction = {p} THEN {weight} ELSE 0 END)::BIGINT AS {name}"
        for name, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    )


# --- bootstrap ------------------------------------------------------------------------------------

REPLICATES = 1000
_MIX = f"(xor({{x}} >> 16, {{x}}) * {bootstrap.MULTIPLIER}) % {bootstrap.WORD}"
BOOTSTRAP_SQL = f"""WITH {WINDOW_PREDICTIONS_SQL}, {subject_predictions_sql('mean', 'track, subject_id')},
hashed AS (
  SELECT *, md5(subject_id || ':7') AS h FROM subject_predictions),
drawn AS (
  SELECT track, label, prediction, probability, {BIN_SQL} AS bin, ('0x' || substr(h, 1, 8))::BIGINT AS high,
         (('0x' || substr(h, 9, 8))::BIGINT + r * {bootstrap.STEP}) % {bootstrap.WORD} AS a, r
  FROM hashed, (SELECT unnest(range(0, {REPLICATES + 1})) AS r)),
mixed AS (SELECT *, xor({_MIX.format(x='a')}, high) AS b FROM drawn),
bits AS (SELECT *, {_MIX.format(x='b')} AS c FROM mixed),
weighted AS (
  SELECT track, label, prediction, probability, bin, r, CASE WHEN r = 0 THEN 1 ELSE
         {' + '.join(f'(xor(c >> 16, c) >= {limit})::INT' for limit in bootstrap.poisson_limits())} END AS w
  FROM bits),
bins AS (
  SELECT track, r, bin, sum(w) AS n, {cells_sql('w')}, sum(w * (probability - label) * (probability - label)) AS sq,
         abs(sum(w * label) - sum(w * probability)) AS gap
  FROM weighted GROUP BY track, r, bin),
cells AS (
  SELECT track, r, sum(n) AS n, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp,
         sum(sq) / sum(n) AS brier_score, sum(gap) / sum(n) AS ece FROM bins GROUP BY track, r),
parts AS (SELECT *, {F_PARTS_SQL} FROM cells),
scores AS (SELECT track, r, (tn + tp)::DOUBLE / n AS accuracy, {SCORES_SQL}, brier_score, ece FROM parts),
long AS (UNPIVOT scores ON {', '.join(f'"{m}"' for m in bootstrap.METRICS)} INTO NAME metric VALUE value)
SELECT track, metric, round(max(value) FILTER (r = 0), 6) AS estimate,
       round(quantile_cont(value, 0.025) FILTER (r > 0), 6) AS low,
       round(quantile_cont(value, 0.975) FILTER (r > 0), 6) AS high,
       round(stddev_pop(value) FILTER (r > 0), 6) AS std, count(value) FILTER (r > 0) AS replicates
FROM long GROUP BY track, metric"""


@query("opt_bootstrap_ci", BOOTSTRAP_SQL)
def opt_bootstrap_ci(spark, sf_dir):
    scored = aggregate.to_subjects(window_predictions(spark, sf_dir), "mean", by=["track"])
    found = bootstrap.bootstrap_intervals(scored, ["track"], REPLICATES)
    return found.select(
        "track", "metric", *[r8(c, digits=6) for c in ("estimate", "low", "high", "std")], "replicates"
    )


# --- slices ---------------------------------------------------------------------------------------

CUSTOMER_PREDICTIONS_SQL = f"""{SUBJECTS_SQL},
scored AS (
  SELECT o_custkey AS subject_id, count(*) AS num_windows, round(avg(l_quantity / 50.0::DOUBLE), 12) AS probability
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey),
subject_predictions AS (
  SELECT s.*, label_binary AS label_01, num_windows, probability,
         CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS prediction
  FROM scored JOIN subjects s USING (subject_id))"""


def customer_predictions(spark, sf_dir):
    """Predictions of the labelled subjects, from the lines of all their orders."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("subject_id"))
    windows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        "subject_id",
        F.lit(None).cast("int").alias("label"),
        (F.col("l_quantity") / F.lit(50.0)).alias("window_probability"),
    )
    scored = aggregate.to_subjects(windows, "mean").drop("label")
    known = subjects(spark, sf_dir).drop("label")
    return scored.join(known, "subject_id").withColumnRenamed("label_binary", "label")


AGE_BUCKETS_SQL = """CASE WHEN age BETWEEN 18 AND 30 THEN '18-30' WHEN age BETWEEN 31 AND 45 THEN '31-45'
         WHEN age BETWEEN 46 AND 60 THEN '46-60' WHEN age >= 61 THEN '61+' ELSE 'unknown' END"""
BAND_SQL = """CASE WHEN phq <= 4 THEN '0-4_minimal' WHEN phq <= 9 THEN '5-9_mild' WHEN phq <= 14 THEN '10-14_moderate'
         WHEN phq <= 19 THEN '15-19_mod_severe' ELSE '20-27_severe' END"""
SLICES_SQL = f"""WITH {CUSTOMER_PREDICTIONS_SQL},
facts AS (
  SELECT label_01 AS label, prediction, probability, 'all' AS overall, gender, {AGE_BUCKETS_SQL} AS age_bucket,
         CASE WHEN subject_id >= 492 THEN 'ai' ELSE 'woz' END AS session_type, {BAND_SQL} AS severity
  FROM subject_predictions),
sliced AS (UNPIVOT facts ON overall, gender, age_bucket, session_type, severity INTO NAME slice VALUE value),
cells AS (
  SELECT slice, value, count(*) AS num_subjects, {cells_sql()},
         avg((probability - label) * (probability - label)) AS brier_score FROM sliced GROUP BY slice, value),
parts AS (SELECT *, {F_PARTS_SQL} FROM cells),
scores AS (SELECT slice, value, num_subjects, tn, fp, fn, tp, brier_score, {SCORES_SQL} FROM parts),
gaps AS (
  SELECT slice, value, sum(gap) / sum(n) AS ece FROM (
    SELECT slice, value, {BIN_SQL} AS bin, count(*) AS n, abs(sum(label) - sum(probability)) AS gap
    FROM sliced GROUP BY slice, value, bin) GROUP BY slice, value),
points AS (
  SELECT slice, value, probability, sum(label) AS pos, sum(1 - label) AS neg
  FROM sliced GROUP BY slice, value, probability),
ranked AS (
  SELECT *, coalesce(sum(pos) OVER w, 0) AS tp0, coalesce(sum(neg) OVER w, 0) AS fp0 FROM points
  WINDOW w AS (PARTITION BY slice, value ORDER BY probability DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ranking AS (
  SELECT slice, value,
         sum(neg * (tp0 + pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) AS auroc,
         sum(pos * ((tp0 + pos)::DOUBLE / (tp0 + pos + fp0 + neg)::DOUBLE)) / sum(pos)::DOUBLE AS pr_auc
  FROM ranked GROUP BY slice, value HAVING sum(pos) > 0 AND sum(neg) > 0)
SELECT slice, value, num_subjects, tn, fp, fn, tp, round(brier_score, 8) AS brier_score,
       round("precision", 8) AS "precision", round(recall, 8) AS recall, round(macro_f1, 8) AS macro_f1,
       round(weighted_f1, 8) AS weighted_f1, round(ece, 8) AS ece,
       coalesce(round(auroc, 8), 'nan'::DOUBLE) AS auroc, coalesce(round(pr_auc, 8), 'nan'::DOUBLE) AS pr_auc
FROM scores JOIN gaps USING (slice, value) LEFT JOIN ranking USING (slice, value)"""


@query("opt_slice_metrics", SLICES_SQL)
def opt_slice_metrics(spark, sf_dir):
    slices = {
        "overall": F.lit("all"),
        "gender": F.col("gender"),
        "age_bucket": L.age_bucket(F.col("age")),
        "session_type": L.session_type(F.col("subject_id")),
        "severity": L.severity_band(F.col("phq")),
    }
    found = metrics.slice_metrics(customer_predictions(spark, sf_dir), slices)
    figures = ("brier_score", "precision", "recall", "macro_f1", "weighted_f1", "ece", "auroc", "pr_auc")
    return found.select("slice", "value", "num_subjects", "tn", "fp", "fn", "tp", *[r8(c) for c in figures])


# --- abstaining -----------------------------------------------------------------------------------

COVERAGE_SQL = f"""WITH {WINDOW_PREDICTIONS_SQL}, {subject_predictions_sql('mean', 'track, subject_id')},
points AS (
  SELECT track, greatest(probability, 1.0::DOUBLE - probability) AS threshold, count(*) AS subjects,
         sum((prediction <> label)::INT) AS wrong
  FROM subject_predictions GROUP BY ALL),
curve AS (
  SELECT track, threshold, subjects, sum(subjects) OVER w AS covered,
         sum(subjects) OVER w / sum(subjects) OVER (PARTITION BY track) AS coverage,
         sum(wrong) OVER w / sum(subjects) OVER w AS risk
  FROM points WINDOW w AS (PARTITION BY track ORDER BY threshold DESC))"""


def track_subjects(spark, sf_dir):
    return aggregate.to_subjects(window_predictions(spark, sf_dir), "mean", by=["track"])


@query(
    "opt_risk_coverage",
    f"""{COVERAGE_SQL}
SELECT track, round(threshold, 8) AS threshold, subjects, covered::BIGINT AS covered,
       round(coverage, 8) AS coverage, round(risk, 8) AS risk FROM curve""",
)
def opt_risk_coverage(spark, sf_dir):
    return selective.risk_coverage(track_subjects(spark, sf_dir), ["track"]).select(
        "track", r8("threshold"), "subjects", "covered", r8("coverage"), r8("risk")
    )


TARGETS = (0.1, 0.4, 0.5)


@query(
    "opt_risk_summary",
    f"""{COVERAGE_SQL},
whole AS (
  SELECT track, sum(subjects)::BIGINT AS subjects, arg_max(risk, covered) AS full_risk,
         sum(risk * subjects) / sum(subjects) AS aurc FROM curve GROUP BY track),
targets(target) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in TARGETS)})
SELECT w.track, w.subjects, round(full_risk, 8) AS full_risk, round(aurc, 8) AS aurc, target,
       round(min(threshold) FILTER (risk <= target), 8) AS threshold,
       round(max(coverage) FILTER (risk <= target), 8) AS coverage
FROM whole w CROSS JOIN targets JOIN curve c USING (track)
GROUP BY w.track, w.subjects, full_risk, aurc, target""",
)
def opt_risk_summary(spark, sf_dir):
    found = selective.selective_summary(track_subjects(spark, sf_dir), ["track"], TARGETS)
    return found.select(
        "track", "subjects", r8("full_risk"), r8("aurc"), "target", r8("threshold"), r8("coverage")
    )


# --- documents ------------------------------------------------------------------------------------


@query(
    "agg_calibration_summary",
    f"""{F4_MEAN}, {EDGES_SQL}, {CONFUSION_SQL},
whole AS (
  SELECT (SELECT num_subjects FROM confusion) AS num_subjects, (SELECT brier_score FROM confusion) AS brier_score,
         sum(abs(acc - conf) * n) FILTER (n > 0) / (SELECT count(*) FROM subject_predictions) AS ece FROM bins)
SELECT num_subjects, round(ece, 8) AS ece, round(brier_score, 8) AS brier_score, bin_index::BIGINT AS bin_index,
       round(lo, 8) AS "left", round(hi, 8) AS "right", n AS "count", round(conf, 8) AS mean_confidence,
       round(acc, 8) AS mean_accuracy FROM whole CROSS JOIN bins""",
)
def agg_calibration_summary(spark, sf_dir):
    record = metrics.calibration_record(mean_subjects(spark, sf_dir))
    return record.select("num_subjects", r8("ece"), r8("brier_score"), F.explode("bins").alias("b")).select(
        "num_subjects",
        "ece",
        "brier_score",
        long("b.bin_index", "bin_index"),
        *[r8(f"b.{c}", c) for c in ("left", "right")],
        F.col("b.count").alias("count"),
        *[r8(f"b.{c}", c) for c in ("mean_confidence", "mean_accuracy")],
    )


REVIEW_SQL = """SELECT '{name}' AS list, row_number() OVER (ORDER BY {order}, subject_id) AS position, subject_id,
         probability FROM subject_predictions WHERE {condition} QUALIFY position <= 10"""


@query(
    "sink_error_review",
    f"""{F4_MEAN}, counts AS (
  SELECT sum((label = 0 AND prediction = 1)::INT)::BIGINT AS false_positives,
         sum((label = 1 AND prediction = 0)::INT)::BIGINT AS false_negatives,
         sum((num_windows <= 2)::INT)::BIGINT AS sparse_subjects FROM subject_predictions),
lists AS (
  {REVIEW_SQL.format(name='top_false_positives', order='probability DESC', condition='label = 0 AND prediction = 1')}
  UNION ALL
  {REVIEW_SQL.format(name='top_false_negatives', order='probability', condition='label = 1 AND prediction = 0')}
  UNION ALL
  {REVIEW_SQL.format(name='sparse_failures', order='probability DESC', condition='num_windows <= 2 AND prediction <> label')})
SELECT counts.*, list, position::BIGINT AS position, subject_id, round(probability, 8) AS probability
FROM counts CROSS JOIN lists""",
)
def sink_error_review(spark, sf_dir):
    path = register(new_shared_path(spark, "error-review"))
    writers.write_error_review(mean_subjects(spark, sf_dir), path)
    back = writers.read_error_review(spark, path)
    lists = F.array(*[F.struct(F.lit(n).alias("list"), F.col(n).alias("rows")) for n in writers.REVIEW_LISTS])
    counts = ["false_positives", "false_negatives", "sparse_subjects"]
    return (
        back.select(*counts, F.explode(lists).alias("l"))
        .select(*counts, "l.list", F.posexplode("l.rows").alias("at", "r"))
        .select(*counts, "list", (F.col("at") + 1).cast("long").alias("position"), "r.subject_id", r8("r.probability", "probability"))
    )


# --- transcripts ----------------------------------------------------------------------------------


@query(
    "opt_transcript_audit",
    """WITH t AS (
  SELECT conv_id, role, coalesce(text, '') AS text,
         len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS tokens FROM conversations),
s AS (
  SELECT role, conv_id, count(*) AS turns, sum(tokens) AS tokens, sum((tokens > 0 AND tokens < 5)::INT) AS short,
         sum((tokens = 0)::INT) AS scrubbed, sum((rtrim(text, ' ') LIKE '%?')::INT) AS question FROM t GROUP BY role, conv_id),
c AS (SELECT role, median(tokens) AS med FROM s GROUP BY role),
d AS (SELECT role, median(abs(tokens - med)) AS mad FROM s JOIN c USING (role) GROUP BY role)
SELECT role, count(*) AS sessions, sum(turns)::BIGINT AS turns, sum(tokens)::BIGINT AS tokens,
       max(med)::DOUBLE AS median_tokens, max(mad)::DOUBLE AS mad_tokens,
       sum((abs(tokens - med) > 3.0::DOUBLE * 1.4826::DOUBLE * mad)::INT)::BIGINT AS odd_sessions,
       round(sum(short) / sum(turns), 8) AS short_share, round(sum(scrubbed) / sum(turns), 8) AS scrubbed_share,
       round(sum(question) / sum(turns), 8) AS question_share, round(sum(tokens) / count(*), 8) AS mean_tokens,
       round(sum((abs(tokens - med) > 3.0::DOUBLE * 1.4826::DOUBLE * mad)::INT) / count(*), 8) AS odd_share
FROM s JOIN c USING (role) JOIN d USING (role) GROUP BY role""",
)
def opt_transcript_audit(spark, sf_dir):
    found = transcripts.transcript_audit(table(spark, sf_dir, "conversations"))
    shares = ("short_share", "scrubbed_share", "question_share", "mean_tokens", "odd_share")
    return found.select(
        "role", "sessions", "turns", "tokens", "median_tokens", "mad_tokens", "odd_sessions", *[r8(c) for c in shares]
    )
