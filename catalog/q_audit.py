"""Label projections, audits, cross references, set operations and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import long, query, r8
from catalog.tables import (
    SUBJECTS_SQL,
    VECTOR_FRAMES_SQL,
    VECTOR_WIDTH,
    fold_by,
    frames,
    frames_sql,
    subjects,
    table,
    vector_frames,
)
from seqloom.functions import labels
from seqloom.operators import audit, manifest

S = f"WITH {SUBJECTS_SQL}"


# --- projections ----------------------------------------------------------------------------------


@query("flt_fold", f"{S} SELECT subject_id, gender FROM subjects WHERE fold = 'dev'")
def flt_fold(spark, sf_dir):
    return subjects(spark, sf_dir).where(F.col("fold") == "dev").select("subject_id", "gender")


@query(
    "prj_fold_alias",
    f"""{S}, v AS (SELECT subject_id, CASE WHEN fold = 'dev' THEN 'valid' ELSE fold END AS fold FROM subjects)
SELECT subject_id, CASE WHEN fold = 'valid' THEN 'dev' ELSE fold END AS fold FROM v""",
)
def prj_fold_alias(spark, sf_dir):
    stored = subjects(spark, sf_dir).withColumn(
        "fold", F.when(F.col("fold") == "dev", F.lit("valid")).otherwise(F.col("fold"))
    )
    return stored.select("subject_id", labels.fold_alias(F.col("fold")).alias("fold"))


@query(
    "prj_label_binary",
    f"""{S} SELECT subject_id, CASE WHEN label = 'depression' THEN 1 ELSE 0 END::BIGINT AS label_binary
FROM subjects""",
)
def prj_label_binary(spark, sf_dir):
    return subjects(spark, sf_dir).select(
        "subject_id", long(labels.label_binary(F.col("label")), "label_binary")
    )


# item i of a customer is (key * (i + 2)) mod 4, left empty for every eleventh key and unreadable
# for every thirteenth
def phq_items(spark, sf_dir):
    key = F.col("c_custkey")
    items = [
        F.when(key % (10 + i) == 0, F.lit(""))
        .when(key % (12 + i) == 0, F.lit("n/a"))
        .otherwise(((key * (i + 2)) % 4).cast("string"))
        .alias(f"PHQ8_{i}_item")
        for i in range(1, 9)
    ]
    age = (
        F.when(key % 9 == 0, F.lit(""))
        .when(key % 10 == 0, F.lit("old"))
        .otherwise(F.concat(F.lit(" "), (key % 60 + 10).cast("string"), F.lit(" ")))
        .alias("age")
    )
    return table(spark, sf_dir, "customer").select(
        key.alias("Participant"),
        *items,
        (F.col("c_acctbal") < 0).cast("int").alias("Depression_label"),
        fold_by(key).alias("split"),
        F.col("c_mktsegment").alias("gender"),
        age,
    )


def _phq_item_sql(i):
    return (
        f"CASE WHEN c_custkey % {10 + i} = 0 OR c_custkey % {12 + i} = 0 THEN 0"
        f" ELSE (c_custkey * {i + 2}) % 4 END"
    )


PHQ_TOTAL_SQL = " + ".join(_phq_item_sql(i) for i in range(1, 9))


@query(
    "prj_phq_total",
    f"SELECT c_custkey AS subject_id, ({PHQ_TOTAL_SQL})::BIGINT AS phq_total FROM customer",
)
def prj_phq_total(spark, sf_dir):
    raw = phq_items(spark, sf_dir)
    total = labels.phq_total([F.col(c) for c in labels.phq_columns(raw)])
    return raw.select(F.col("Participant").alias("subject_id"), long(total, "phq_total"))


AGE_SQL = "CASE WHEN c_custkey % 9 = 0 OR c_custkey % 10 = 0 THEN -1 ELSE c_custkey % 60 + 10 END"


@query("prj_age", f"SELECT c_custkey AS subject_id, ({AGE_SQL})::BIGINT AS age FROM customer")
def prj_age(spark, sf_dir):
    return phq_items(spark, sf_dir).select(
        F.col("Participant").alias("subject_id"), long(labels.age_or_unknown(F.col("age")), "age")
    )


BAND_SQL = """CASE WHEN phq <= 4 THEN '0-4_minimal' WHEN phq <= 9 THEN '5-9_mild'
  WHEN phq <= 14 THEN '10-14_moderate' WHEN phq <= 19 THEN '15-19_mod_severe' ELSE '20-27_severe' END"""


@query("prj_severity_band", f"{S} SELECT subject_id, {BAND_SQL} AS band FROM subjects")
def prj_severity_band(spark, sf_dir):
    return subjects(spark, sf_dir).select(
        "subject_id", labels.severity_band(F.col("phq")).alias("band")
    )


SESSION_SQL = "CASE WHEN subject_id >= 492 THEN 'ai' ELSE 'woz' END"


@query("prj_session_type", f"{S} SELECT subject_id, {SESSION_SQL} AS session_type FROM subjects")
def prj_session_type(spark, sf_dir):
    return subjects(spark, sf_dir).select(
        "subject_id", labels.session_type(F.col("subject_id")).alias("session_type")
    )


# --- counts ---------------------------------------------------------------------------------------


@query(
    "agg_counts",
    f"""{S}
SELECT 'fold' AS attribute, fold AS "value", count(*) AS "count" FROM subjects GROUP BY fold
UNION ALL SELECT 'label', label, count(*) FROM subjects GROUP BY label
UNION ALL SELECT 'gender', gender, count(*) FROM subjects GROUP BY gender""",
)
def agg_counts(spark, sf_dir):
    return audit.value_counts(subjects(spark, sf_dir), ["fold", "label", "gender"])


@query(
    "agg_fold_label",
    f"""{S} SELECT fold, label, count(*) AS "count" FROM subjects GROUP BY fold, label""",
)
def agg_fold_label(spark, sf_dir):
    return audit.fold_label_counts(subjects(spark, sf_dir))


@query(
    "agg_split_rate",
    f"""{S} SELECT fold, count(*) AS total, sum(label_binary)::BIGINT AS positives,
       round(sum(label_binary) / count(*), 8) AS rate
FROM subjects GROUP BY fold""",
)
def agg_split_rate(spark, sf_dir):
    rates = audit.split_rates(subjects(spark, sf_dir))
    return rates.select(
        "fold", "total", "positives", r8(F.col("positives") / F.col("total"), "rate")
    )


def _stats_sql(column, source, where="TRUE"):
    return f"""SELECT min({column})::BIGINT AS "min", max({column})::BIGINT AS "max",
       round(avg({column}), 6) AS mean, median({column})::DOUBLE AS median,
       round(stddev_pop({column}), 6) AS std FROM {source} WHERE {where}"""


def _stats_out(df, *by):
    return df.select(
        *by, long("min"), long("max"), r8("mean", digits=6), "median", r8("std", digits=6)
    )


@query("agg_age_stats", f"{S} {_stats_sql('age', 'subjects', 'age > 0')}")
def agg_age_stats(spark, sf_dir):
    return _stats_out(audit.numeric_stats(subjects(spark, sf_dir).where("age > 0"), "age"))


@query("agg_phq_stats", f"{S} {_stats_sql('phq', 'subjects')}")
def agg_phq_stats(spark, sf_dir):
    return _stats_out(audit.numeric_stats(subjects(spark, sf_dir), "phq"))


@query(
    "agg_severity_hist",
    f"""{S}, bands(band_order, band) AS (VALUES (0, '0-4_minimal'), (1, '5-9_mild'), (2, '10-14_moderate'),
  (3, '15-19_mod_severe'), (4, '20-27_severe')),
found AS (SELECT {BAND_SQL} AS band FROM subjects)
SELECT band_order::BIGINT AS band_order, b.band, count(found.band) AS "count"
FROM bands b LEFT JOIN found ON found.band = b.band GROUP BY band_order, b.band""",
)
def agg_severity_hist(spark, sf_dir):
    return audit.severity_histogram(subjects(spark, sf_dir)).select(long("band_order"), "band", "count")


@query(
    "agg_session_counts",
    f"""{S} SELECT {SESSION_SQL} AS session_type, count(*) AS "count" FROM subjects GROUP BY 1""",
)
def agg_session_counts(spark, sf_dir):
    return audit.session_counts(subjects(spark, sf_dir))


@query(
    "agg_id_range",
    """SELECT count(*) AS total, min(c_custkey) AS first, max(c_custkey) AS last FROM customer""",
)
def agg_id_range(spark, sf_dir):
    return audit.id_range(table(spark, sf_dir, "customer"), "c_custkey")


# --- frame checks ---------------------------------------------------------------------------------

# Sequences as stored: every seventh user has no visual file, every fifth no acoustic file.
AVAILABLE_SQL = """((modality = 'visual' AND subject_id % 7 <> 0)
    OR (modality = 'acoustic' AND subject_id % 5 <> 0))"""
SHAPES_SQL = f"""WITH {frames_sql()},
stored AS (SELECT * FROM frames WHERE {AVAILABLE_SQL}),
shapes AS (SELECT subject_id, modality, count(*) AS len, 2 AS dim FROM stored GROUP BY subject_id, modality),
wide AS (
  SELECT subject_id, max(CASE WHEN modality = 'acoustic' THEN len END) AS acoustic_len,
         max(CASE WHEN modality = 'visual' THEN len END) AS visual_len,
         max(CASE WHEN modality = 'acoustic' THEN dim END) AS acoustic_dim,
         max(CASE WHEN modality = 'visual' THEN dim END) AS visual_dim
  FROM shapes GROUP BY subject_id),
wide_aligned AS (SELECT *, least(acoustic_len, visual_len) AS aligned_len FROM wide)"""


def stored_frames(spark, sf_dir):
    visual, subject = F.col("modality") == "visual", F.col("subject_id")
    return frames(spark, sf_dir).where(
        (visual & (subject % 7 != 0)) | (~visual & (subject % 5 != 0))
    )


def wide_shapes(spark, sf_dir):
    return audit.modality_shapes(audit.sequence_shapes(stored_frames(spark, sf_dir)))


@query(
    "prj_aligned_len",
    f"{SHAPES_SQL} SELECT subject_id, acoustic_len, visual_len, aligned_len FROM wide_aligned",
)
def prj_aligned_len(spark, sf_dir):
    return wide_shapes(spark, sf_dir).select(
        "subject_id", "acoustic_len", "visual_len", "aligned_len"
    )


@query(
    "flt_modality",
    f"""{SHAPES_SQL} SELECT subject_id FROM wide
WHERE acoustic_len IS NOT NULL AND visual_len IS NOT NULL""",
)
def flt_modality(spark, sf_dir):
    both = F.col("acoustic_len").isNotNull() & F.col("visual_len").isNotNull()
    return wide_shapes(spark, sf_dir).where(both).select("subject_id")


@query(
    "agg_length_stats",
    f"""{SHAPES_SQL}, paired AS (SELECT * FROM wide_aligned WHERE acoustic_len IS NOT NULL AND visual_len IS NOT NULL)
SELECT 'aligned' AS measure, * FROM ({_stats_sql("aligned_len", "paired")})
UNION ALL SELECT 'acoustic', * FROM ({_stats_sql("acoustic_len", "paired")})
UNION ALL SELECT 'visual', * FROM ({_stats_sql("visual_len", "paired")})""",
)
def agg_length_stats(spark, sf_dir):
    return _stats_out(audit.length_stats(wide_shapes(spark, sf_dir)), "measure")


@query(
    "agg_length_mismatch",
    f"""{SHAPES_SQL} SELECT subject_id, acoustic_len, visual_len, abs(acoustic_len - visual_len) AS diff
FROM wide WHERE acoustic_len <> visual_len""",
)
def agg_length_mismatch(spark, sf_dir):
    return audit.length_mismatches(wide_shapes(spark, sf_dir))


# a few frames get a NaN or an infinite entry
DAMAGED_SQL = f"""WITH {frames_sql()},
damaged AS (
  SELECT subject_id, modality,
         CASE WHEN f1 = 7 AND subject_id % 4 = 0 THEN 'nan'::DOUBLE
              WHEN f1 = 9 AND subject_id % 4 = 1 THEN '-inf'::DOUBLE ELSE f0 END AS f0, f1
  FROM frames)"""


@query(
    "agg_nan_inf",
    f"""{DAMAGED_SQL}
SELECT subject_id, modality, bool_or(isnan(f0)) AS has_nan, bool_or(isinf(f0)) AS has_inf
FROM damaged GROUP BY subject_id, modality""",
)
def agg_nan_inf(spark, sf_dir):
    value, k, subject = F.col("features")[0], F.col("features")[1], F.col("subject_id")
    spoiled = (
        F.when((k == 7) & (subject % 4 == 0), F.lit(float("nan")))
        .when((k == 9) & (subject % 4 == 1), F.lit(float("-inf")))
        .otherwise(value)
    )
    damaged = frames(spark, sf_dir).withColumn("features", F.array(spoiled, k))
    return audit.nan_inf(damaged)


@query(
    "agg_dtype_dim",
    f"""WITH {VECTOR_FRAMES_SQL}
SELECT subject_id, CASE WHEN subject_id % 2 = 0 THEN 'visual' ELSE 'acoustic' END AS modality,
       max(len(features))::BIGINT AS actual_dim, 25::BIGINT AS expected_dim
FROM vector_frames GROUP BY subject_id HAVING subject_id % 2 = 1""",
)
def agg_dtype_dim(spark, sf_dir):
    subject = F.col("subject_id")
    rows = vector_frames(spark, sf_dir).withColumn(
        "modality", F.when(subject % 2 == 0, F.lit("visual")).otherwise(F.lit("acoustic"))
    )
    issues = audit.dimension_issues(
        audit.sequence_shapes(rows), {"visual": VECTOR_WIDTH, "acoustic": 25}
    )
    return issues.select("subject_id", "modality", long("actual_dim"), long("expected_dim"))


@query(
    "agg_extract_quality",
    f"""WITH {frames_sql()}
SELECT subject_id, round(avg(confidence), 8) AS confidence_mean,
       round(avg(CASE WHEN confidence < 0.5 THEN 1.0 ELSE 0.0 END), 8) AS low_confidence_ratio,
       round(avg(CASE WHEN success > 0 THEN 1.0 ELSE 0.0 END), 8) AS success_ratio
FROM frames WHERE modality = 'visual' GROUP BY subject_id""",
)
def agg_extract_quality(spark, sf_dir):
    visual = frames(spark, sf_dir).where(F.col("modality") == "visual")
    return audit.extraction_quality(visual).select(
        "subject_id", r8("confidence_mean"), r8("low_confidence_ratio"), r8("success_ratio")
    )


# --- extraction status ----------------------------------------------------------------------------

STATUS_SQL = f"""{SHAPES_SQL},
all_subjects AS (SELECT DISTINCT user_id AS subject_id FROM events),
extracted AS (
  SELECT s.subject_id, acoustic_len, visual_len, acoustic_dim, visual_dim,
         CASE WHEN acoustic_len IS NOT NULL AND visual_len IS NOT NULL THEN 'success'
              WHEN acoustic_len IS NOT NULL OR visual_len IS NOT NULL THEN 'partial'
              ELSE 'failed' END AS status
  FROM all_subjects s LEFT JOIN wide w ON w.subject_id = s.subject_id)"""


def extraction_results(spark, sf_dir):
    everyone = frames(spark, sf_dir).select("subject_id").distinct()
    joined = everyone.join(wide_shapes(spark, sf_dir), "subject_id", "left")
    status = labels.extraction_status(
        F.col("visual_len").isNotNull(), F.col("acoustic_len").isNotNull()
    )
    warnings = (
        F.when(status == "partial", F.array(F.lit("partial_subject_recovered")))
        .when(status == "failed", F.array(F.lit("no_required_features_recovered")))
        .otherwise(F.array().cast("array<string>"))
    )
    return joined.withColumns({"status": status, "warnings": warnings})


@query("prj_extract_status", f"{STATUS_SQL} SELECT subject_id, status FROM extracted")
def prj_extract_status(spark, sf_dir):
    return extraction_results(spark, sf_dir).select("subject_id", "status")


@query(
    "agg_extract_report",
    f"""{STATUS_SQL} SELECT s.status, count(e.status) AS "count"
FROM (VALUES ('success'), ('partial'), ('failed'), ('skipped')) s(status)
LEFT JOIN extracted e ON e.status = s.status GROUP BY s.status""",
)
def agg_extract_report(spark, sf_dir):
    return audit.extraction_report(extraction_results(spark, sf_dir))


@query(
    "agg_extract_summary",
    f"""{STATUS_SQL}
SELECT sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END)::BIGINT AS complete,
       sum(CASE WHEN status = 'partial' THEN 1 ELSE 0 END)::BIGINT AS partial,
       sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END)::BIGINT AS failed,
       array_to_string(list_sort(list(DISTINCT visual_dim) FILTER (visual_dim IS NOT NULL)), ',') AS visual_dims,
       array_to_string(list_sort(list(DISTINCT acoustic_dim) FILTER (acoustic_dim IS NOT NULL)), ',') AS acoustic_dims,
       round(avg(visual_len), 6) AS visual_len_mean, round(avg(acoustic_len), 6) AS acoustic_len_mean
FROM extracted""",
)
def agg_extract_summary(spark, sf_dir):
    return audit.extraction_summary(extraction_results(spark, sf_dir)).select(
        "complete",
        "partial",
        "failed",
        *[
            F.concat_ws(",", F.col(c).cast("array<string>")).alias(c)
            for c in ("visual_dims", "acoustic_dims")
        ],
        r8("visual_len_mean", digits=6),
        r8("acoustic_len_mean", digits=6),
    )


# --- joins and set operations ---------------------------------------------------------------------


@query(
    "join_label_features",
    f"""{SHAPES_SQL}, {SUBJECTS_SQL}
SELECT s.subject_id, s.label, s.fold, w.acoustic_len, w.visual_len FROM subjects s JOIN wide w
  ON w.subject_id = s.subject_id WHERE acoustic_len IS NOT NULL AND visual_len IS NOT NULL""",
)
def join_label_features(spark, sf_dir):
    both = wide_shapes(spark, sf_dir).where("acoustic_len is not null and visual_len is not null")
    joined = subjects(spark, sf_dir).join(both, "subject_id")
    return joined.select("subject_id", "label", "fold", "acoustic_len", "visual_len")


@query(
    "join_label_default",
    """SELECT d.doc_id, d.n_chars, coalesce(CAST(quality AS VARCHAR), 'unknown') AS label,
       coalesce(CAST(toxic AS VARCHAR), 'unknown') AS fold
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def join_label_default(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select(
        "doc_id",
        F.col("quality").cast("string").alias("label"),
        F.col("toxic").cast("string").alias("fold"),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return audit.with_label_or_unknown(docs, known, "doc_id")


@query(
    "join_anti_labelled",
    """SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def join_anti_labelled(spark, sf_dir):
    return audit.missing_from(*_order_ids(spark, sf_dir), "id")


def _order_ids(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    return orders, lines


@query(
    "join_anti_unlabelled",
    """SELECT DISTINCT l_orderkey AS id FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""",
)
def join_anti_unlabelled(spark, sf_dir):
    labelled = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "P")
    _, lines = _order_ids(spark, sf_dir)
    return audit.missing_from(lines, labelled.select(F.col("o_orderkey").alias("id")), "id")


@query(
    "set_difference_ids",
    """SELECT o_orderkey AS id FROM orders EXCEPT SELECT l_orderkey FROM lineitem""",
)
def set_difference_ids(spark, sf_dir):
    orders, lines = _order_ids(spark, sf_dir)
    return orders.subtract(lines.distinct())


def video_tables(spark, sf_dir):
    key = F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("key")
    links = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), key)
    return links, table(spark, sf_dir, "labels").select(key)


@query(
    "join_video_semi",
    """SELECT doc_id AS video_id, 'v' || doc_id AS "key",
       doc_id IN (SELECT doc_id FROM labels) AS has_raw_video FROM documents""",
)
def join_video_semi(spark, sf_dir):
    return audit.video_presence(*video_tables(spark, sf_dir))


@query(
    "agg_video_coverage",
    """SELECT count(*) AS total_linked, count(l.doc_id) AS subjects_with_video,
       count(*) - count(l.doc_id) AS subjects_without_video,
       (SELECT count(DISTINCT doc_id) FROM labels) AS videos_downloaded
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""",
)
def agg_video_coverage(spark, sf_dir):
    return audit.video_coverage(*video_tables(spark, sf_dir))


@query(
    "join_issues",
    f"""{STATUS_SQL}
SELECT c_custkey AS subject_id, e.status AS issue_status,
       CASE e.status WHEN 'partial' THEN 'partial_subject_recovered'
            WHEN 'failed' THEN 'no_required_features_recovered' END AS issue
FROM customer LEFT JOIN (SELECT * FROM extracted WHERE status IN ('partial', 'failed')) e
  ON e.subject_id = c_custkey""",
)
def join_issues(spark, sf_dir):
    issues = audit.extraction_errors(extraction_results(spark, sf_dir)).select(
        "subject_id", F.col("status").alias("issue_status"), F.array_join("warnings", "; ").alias("issue")
    )
    return subjects(spark, sf_dir).select("subject_id").join(issues, "subject_id", "left")


# a leak is planted: subjects divisible by 50 are listed in the test fold as well
@query(
    "set_fold_overlap",
    f"""{S}, members AS (
  SELECT subject_id, fold FROM subjects
  UNION ALL SELECT subject_id, 'test' FROM subjects WHERE subject_id % 50 = 0),
pairs(fold_a, fold_b) AS (VALUES ('train', 'dev'), ('train', 'test'), ('dev', 'test')),
shared AS (
  SELECT fold_a, fold_b, (SELECT count(*) FROM (
      SELECT subject_id FROM members WHERE fold = fold_a INTERSECT
      SELECT subject_id FROM members WHERE fold = fold_b)) AS overlap FROM pairs)
SELECT fold_a, fold_b, overlap, CASE WHEN overlap = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
       (SELECT count(DISTINCT subject_id) FROM members) AS total_subjects FROM shared""",
)
def set_fold_overlap(spark, sf_dir):
    base = subjects(spark, sf_dir).select("subject_id", "fold")
    leaked = base.where(F.col("subject_id") % 50 == 0).withColumn("fold", F.lit("test"))
    return audit.fold_overlap(base.unionByName(leaked), ["train", "dev", "test"])


@query(
    "set_corpus_overlap",
    """SELECT c_custkey AS subject_id FROM customer INTERSECT SELECT s_suppkey FROM supplier""",
)
def set_corpus_overlap(spark, sf_dir):
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"))
    second = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("subject_id"))
    return audit.corpus_overlap(first, second)


# --- manifests ------------------------------------------------------------------------------------


def with_paths(shapes):
    def path(modality, suffix):
        return F.when(
            F.col(f"{modality}_len").isNotNull(),
            F.concat(F.lit(f"{modality}{suffix}/"), F.col("subject_id").cast("string")),
        )

    return shapes.withColumns(
        {
            **{f"{m}_path": path(m, "") for m in ("acoustic", "visual")},
            **{f"{m}_timestamps_path": path(m, "_timestamps") for m in ("acoustic", "visual")},
        }
    )


def d_manifest(spark, sf_dir):
    labelled = subjects(spark, sf_dir).select("subject_id", "label", "duration", "gender", "fold")
    links, downloaded = video_tables(spark, sf_dir)
    return manifest.manifest_d(
        labelled, with_paths(wide_shapes(spark, sf_dir)), links, downloaded
    )


def e_manifest(spark, sf_dir):
    person = subjects(spark, sf_dir).select(
        F.col("subject_id").alias("participant"), "label_binary", "phq", "fold", "gender", "age"
    )
    tag = F.concat(F.col("subject_id").cast("string"), F.lit("_P"))
    results = extraction_results(spark, sf_dir).withColumn("subject_id", tag)
    shapes = with_paths(wide_shapes(spark, sf_dir)).withColumn("subject_id", tag)
    archives = results.select(
        F.regexp_extract("subject_id", r"^(\d+)_P$", 1).cast("long").alias("participant"),
        F.concat("subject_id", F.lit(".tar.gz")).alias("archive_path"),
    )
    return manifest.manifest_e(
        person, shapes, results, audit.extraction_errors(results), archives
    )


D_FLAGS_SQL = """array_to_string(list_filter([
    CASE WHEN acoustic_len <> visual_len THEN 'length_mismatch' END,
    CASE WHEN least(acoustic_len, visual_len) < 30 THEN 'very_short' END,
    CASE WHEN least(acoustic_len, visual_len) > 3600 THEN 'very_long' END], lambda x: x IS NOT NULL), ',')"""
E_FLAGS_SQL = """array_to_string(list_sort(list_filter([
    CASE WHEN e.status = 'partial' THEN 'partial_extraction' END,
    CASE WHEN e.status = 'partial' THEN 'extract_warning:partial_subject_recovered' END,
    CASE WHEN e.status = 'failed' THEN 'extract_warning:no_required_features_recovered' END,
    CASE WHEN e.status IN ('partial', 'failed') THEN 'corrupt_archive' END,
    CASE WHEN e.visual_len IS NULL THEN 'missing_visual' END,
    CASE WHEN e.acoustic_len IS NULL THEN 'missing_acoustic' END,
    CASE WHEN e.visual_len IS NULL AND e.acoustic_len IS NULL THEN 'not_extracted' END,
    CASE WHEN e.acoustic_len <> e.visual_len THEN 'length_mismatch' END,
    CASE WHEN least(e.acoustic_len, e.visual_len) < 30 THEN 'very_short' END], lambda x: x IS NOT NULL)), ',')"""
D_MANIFEST_SQL = f"""d_manifest AS (
  SELECT CAST(s.subject_id AS VARCHAR) AS subject_id, 'dvlog' AS dataset_source,
         label_binary::BIGINT AS label_binary, NULL::BIGINT AS label_phq, fold, gender,
         acoustic_len, visual_len, least(acoustic_len, visual_len) AS aligned_len,
         s.subject_id IN (SELECT doc_id FROM labels) AS has_raw_video,
         CASE WHEN s.subject_id IN (SELECT doc_id FROM documents) THEN 'v' || s.subject_id END AS video_key,
         {D_FLAGS_SQL} AS quality_flags, NULL::BIGINT AS age, NULL::VARCHAR AS session_type,
         NULL::VARCHAR AS extraction_status, NULL::VARCHAR AS extraction_error,
         NULL::VARCHAR AS archive_path
  FROM subjects s JOIN wide w ON w.subject_id = s.subject_id
  WHERE acoustic_len IS NOT NULL AND visual_len IS NOT NULL)"""
E_MANIFEST_SQL = f"""e_manifest AS (
  SELECT s.subject_id || '_P' AS subject_id, 'edaic' AS dataset_source,
         label_binary::BIGINT AS label_binary, phq::BIGINT AS label_phq, fold, gender,
         acoustic_len, visual_len, least(acoustic_len, visual_len) AS aligned_len,
         NULL::BOOLEAN AS has_raw_video, NULL::VARCHAR AS video_key, {E_FLAGS_SQL} AS quality_flags,
         age::BIGINT AS age, CASE WHEN s.subject_id >= 492 THEN 'ai' ELSE 'woz' END AS session_type,
         coalesce(e.status, 'not_extracted') AS extraction_status,
         CASE e.status WHEN 'partial' THEN 'partial_subject_recovered'
              WHEN 'failed' THEN 'no_required_features_recovered' END AS extraction_error,
         CASE WHEN e.subject_id IS NOT NULL THEN s.subject_id || '_P.tar.gz' END AS archive_path
  FROM subjects s LEFT JOIN extracted e ON e.subject_id = s.subject_id)"""


@query(
    "prj_quality_flags",
    f"""{STATUS_SQL}, {SUBJECTS_SQL}, {D_MANIFEST_SQL}, {E_MANIFEST_SQL}
SELECT subject_id, quality_flags FROM d_manifest UNION ALL SELECT subject_id, quality_flags FROM e_manifest""",
)
def prj_quality_flags(spark, sf_dir):
    both = [
        m.select("subject_id", F.concat_ws(",", "quality_flags").alias("quality_flags"))
        for m in (d_manifest(spark, sf_dir), e_manifest(spark, sf_dir))
    ]
    return both[0].unionByName(both[1])


MANIFEST_COLUMNS = (
    "subject_id dataset_source label_binary label_phq fold gender acoustic_len visual_len "
    "aligned_len has_raw_video video_key quality_flags age session_type extraction_status "
    "extraction_error archive_path"
).split()


def manifest_out(df):
    return df.withColumns(
        {
            "quality_flags": F.concat_ws(",", "quality_flags"),
            **{c: F.col(c).cast("long") for c in ("label_binary", "label_phq", "age")},
        }
    ).select(*MANIFEST_COLUMNS)


MANIFEST_SQL = f"""{STATUS_SQL}, {SUBJECTS_SQL}, {D_MANIFEST_SQL}, {E_MANIFEST_SQL}
SELECT * FROM d_manifest UNION ALL SELECT * FROM e_manifest"""


@query("set_union_manifest", MANIFEST_SQL)
def set_union_manifest(spark, sf_dir):
    return manifest_out(
        manifest.union_manifests(d_manifest(spark, sf_dir), e_manifest(spark, sf_dir))
    )


@query(
    "limit_subjects",
    f"{S} SELECT subject_id, label FROM subjects ORDER BY subject_id LIMIT 100",
)
def limit_subjects(spark, sf_dir):
    return subjects(spark, sf_dir).orderBy("subject_id").limit(100).select("subject_id", "label")
