"""Sources and sinks: files are written from the driver tables and read back."""

from __future__ import annotations

import io
import tarfile
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from catalog.q_audit import (
    AGE_SQL,
    MANIFEST_COLUMNS,
    MANIFEST_SQL,
    PHQ_TOTAL_SQL,
    S,
    d_manifest,
    e_manifest,
    manifest_out,
    phq_items,
)
from catalog.q_metrics import CONFUSION_SQL, F1_SQL, mean_subjects
from catalog.q_sequence import STATS_SQL, frame_stats
from catalog.registry import long, query, r8
from catalog.tables import (
    DAY_MICROS,
    F4_MEAN,
    VECTOR_FRAMES_SQL,
    fold_sql,
    frames,
    frames_sql,
    subjects,
    table,
    vector_frames,
)
from seqloom.operators import audit, manifest, normalise
from seqloom.plans import extraction
from seqloom.session import new_shared_path
from seqloom.sources import archives, arrays, files, readers, writers
from seqloom.sources.storage import write_bytes
from seqloom.streaming.ingest import append_new_files

# --- label tables ---------------------------------------------------------------------------------


@query(
    "src_labels_d",
    f"""{S} SELECT CAST(subject_id AS VARCHAR) AS subject_id, label_binary::BIGINT AS label_binary, label,
       round(duration, 6) AS duration, gender, fold FROM subjects""",
)
def src_labels_d(spark, sf_dir):
    path = new_shared_path(spark, "labels-d")
    stored = subjects(spark, sf_dir).select(
        F.col("subject_id").alias("index"), "label", "duration", "gender", "fold"
    )
    writers.write_labels(stored, path)
    return readers.read_labels_d(spark, path).select(
        "subject_id", long("label_binary"), "label", r8("duration", digits=6), "gender", "fold"
    )


@query(
    "src_labels_e",
    f"""SELECT c_custkey AS participant, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END::BIGINT AS label_binary,
       ({PHQ_TOTAL_SQL})::BIGINT AS phq, 8::BIGINT AS items, {fold_sql('c_custkey')} AS fold,
       c_mktsegment AS gender, ({AGE_SQL})::BIGINT AS age FROM customer""",
)
def src_labels_e(spark, sf_dir):
    path = new_shared_path(spark, "labels-e")
    writers.write_labels(phq_items(spark, sf_dir), path)
    return readers.read_labels_e(spark, path).select(
        "participant",
        long("label_binary"),
        long("phq"),
        long(F.size("phq_items"), "items"),
        "fold",
        "gender",
        long("age"),
    )


@query("src_links", """SELECT doc_id AS video_id, 'v' || doc_id AS "key" FROM documents""")
def src_links(spark, sf_dir):
    path = new_shared_path(spark, "links")
    stored = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("video_id"),
        F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("key"),
    )
    writers.write_labels(stored, path)
    return readers.read_links(spark, path)


# --- arrays ---------------------------------------------------------------------------------------


def write_arrays(spark, sf_dir, empty_every=0, single_every=0):
    """One ``<subject>_visual.npy`` per sequence of ten vectors.

    With ``empty_every`` subjects divisible by it also get an acoustic file of no bytes, with
    ``single_every`` those divisible by it are stored at single precision.
    """
    root = new_shared_path(spark, "arrays")

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        subject = int(pdf["subject_id"].iloc[0])
        matrix = np.stack(pdf.sort_values("sec")["features"].to_numpy()).astype(np.float64)
        if single_every and subject % single_every == 0:
            matrix = matrix.astype(np.float32)
        out = io.BytesIO()
        np.save(out, matrix)
        write_bytes(f"{root}/{subject}/{subject}_visual.npy", out.getvalue())
        if empty_every and subject % empty_every == 0:
            write_bytes(f"{root}/{subject}/{subject}_acoustic.npy", b"")
        return pd.DataFrame({"subject_id": [subject]})

    rows = vector_frames(spark, sf_dir).select("subject_id", "sec", "features")
    rows.groupBy("subject_id").applyInPandas(save, "subject_id long").count()
    return files.list_files(spark, root, "*.npy")


def _subject_of(path="path"):
    return F.regexp_extract(path, r"/(\d+)_visual\.npy$", 1).cast("long").alias("subject_id")


@query(
    "src_arrays",
    f"""WITH {VECTOR_FRAMES_SQL}, l AS (
  SELECT subject_id, sec AS t, unnest(range(0, len(features))) AS dim, unnest(features)::DOUBLE AS x
  FROM vector_frames)
SELECT subject_id, t, dim::BIGINT AS dim, round(x, 5) AS x FROM l""",
)
def src_arrays(spark, sf_dir):
    rows = arrays.read_arrays(write_arrays(spark, sf_dir), slice_rows=4)
    long_rows = rows.select(_subject_of(), "t", F.posexplode("features").alias("dim", "x"))
    return long_rows.select("subject_id", "t", long("dim"), r8(F.col("x").cast("double"), "x", digits=5))


@query(
    "src_array_shape",
    f"""WITH {VECTOR_FRAMES_SQL}
SELECT subject_id, count(*) AS "rows", max(len(features))::BIGINT AS width, 'float64' AS dtype
FROM vector_frames GROUP BY subject_id""",
)
def src_array_shape(spark, sf_dir):
    shapes = arrays.array_shapes(write_arrays(spark, sf_dir))
    return shapes.select(_subject_of(), "rows", "width", "dtype")


@query(
    "agg_array_issues",
    f"""WITH {VECTOR_FRAMES_SQL}, s AS (SELECT DISTINCT subject_id FROM vector_frames)
SELECT subject_id, 'visual' AS modality, 'dtype' AS issue, 'float32' AS dtype FROM s WHERE subject_id % 3 = 0
UNION ALL SELECT subject_id, 'acoustic', 'corrupt', NULL FROM s WHERE subject_id % 5 = 0""",
)
def agg_array_issues(spark, sf_dir):
    """Headers of all written files; every fifth subject has an empty file, every third one of single precision."""
    shapes = arrays.array_shapes(write_arrays(spark, sf_dir, empty_every=5, single_every=3))
    named = shapes.select(
        "dtype",
        "error",
        F.regexp_extract("path", r"/(\d+)_(\w+)\.npy$", 1).cast("long").alias("subject_id"),
        F.regexp_extract("path", r"/(\d+)_(\w+)\.npy$", 2).alias("modality"),
    )
    return audit.array_issues(named)


@query(
    "src_files",
    f"""WITH {VECTOR_FRAMES_SQL}
SELECT DISTINCT CAST(subject_id AS VARCHAR) AS subject_id, subject_id % 5 = 0 AS has_acoustic,
       TRUE AS has_visual FROM vector_frames""",
)
def src_files(spark, sf_dir):
    """Every fifth subject has an acoustic file of no bytes, which is listed like any other."""
    found = files.modality_files(write_arrays(spark, sf_dir, empty_every=5))
    return found.select(
        "subject_id",
        F.col("acoustic_path").isNotNull().alias("has_acoustic"),
        F.col("visual_path").isNotNull().alias("has_visual"),
    )


# --- statistics -----------------------------------------------------------------------------------


@query(
    "src_stats",
    STATS_SQL
    + """ SELECT modality, dim::BIGINT AS dim, round(mean, 6) AS mean, round(std, 6) AS std,
       'train' AS source FROM stats""",
)
def src_stats(spark, sf_dir):
    path = new_shared_path(spark, "stats")
    computed = normalise.stats_long(frame_stats(spark, sf_dir), ["modality"])
    provided = computed.withColumns({"mean": F.col("mean") + 1.0, "source": F.lit("provided")})
    writers.write_stats(
        computed.withColumn("source", F.lit("train")).unionByName(provided), path
    )
    loaded = normalise.load_stats(spark.read.parquet(path), "train")
    return loaded.select(
        "modality", long("dim"), r8("mean", digits=6), r8("std", digits=6), "source"
    )


@query(
    "sink_stats",
    STATS_SQL
    + " SELECT modality, dim::BIGINT AS dim, round(mean, 6) AS mean, round(std, 6) AS std FROM stats",
)
def sink_stats(spark, sf_dir):
    path = new_shared_path(spark, "stats-arrays")
    writers.write_stats(normalise.stats_long(frame_stats(spark, sf_dir), ["modality"]), path)
    back = normalise.stats_from_long(spark.read.parquet(path), ["modality"])
    return normalise.stats_long(back, ["modality"]).select(
        "modality", long("dim"), r8("mean", digits=6), r8("std", digits=6)
    )


# --- archives -------------------------------------------------------------------------------------

# 200 consecutive events make one archive; an archive whose number is divisible by 10 lacks the
# acoustic member, one divisible by 7 is cut off in the middle of its last member, and every third of
# those that lack a member (10, 40, 70, ...) is a file of no bytes.
EVENTS_PER_ARCHIVE = 200


def write_archives(spark, sf_dir):
    root = new_shared_path(spark, "archives")
    events = table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / EVENTS_PER_ARCHIVE).cast("long").alias("pid"),
        "event_id",
        "value",
        F.get_json_object("props", "$.k").alias("k"),
        "event_type",
    )
    visual_header = ", ".join(readers.VISUAL_REQUIRED)
    features = len(readers.VISUAL_FEATURES)

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        pid = int(pdf["pid"].iloc[0])
        rows = pdf.sort_values("event_id")
        visual, acoustic = [visual_header], ["name;frameTime;loud;pitch"]
        for r in rows.itertuples(index=False):
            second = (r.event_id % EVENTS_PER_ARCHIVE) / 4
            cells = [f"{r.value + i}" for i in range(features)]
            stamp = "bad" if r.event_id % 17 == 0 else f"{second}"
            ok = 0 if r.event_type == "error" else 1
            visual.append(f" {stamp} , {1 - int(r.k) / 100}, {ok}, " + ", ".join(cells))
            acoustic.append(f"'frame';{second};{r.value};{r.k}")
        members = {"visual": "\n".join(visual), "acoustic": "\n".join(acoustic)}
        if pid % 10 == 0:
            del members["acoustic"]
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for kind, text in members.items():
                payload = text.encode()
                info = tarfile.TarInfo(f"{pid}_P/" + archives.PAYLOADS[kind].format(pid=pid))
                info.size = len(payload)
                middle = tar.offset + tarfile.BLOCKSIZE + len(payload) // 2
                tar.addfile(info, io.BytesIO(payload))
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        if pid % 30 == 10:
            data = b""
        elif pid % 7 == 0:
            data = packer.compress(out.getvalue()[:middle]) + packer.flush(zlib.Z_FULL_FLUSH)
        else:
            data = packer.compress(out.getvalue()) + packer.flush()
        write_bytes(f"{root}/{pid}_P.tar.gz", data)
        return pd.DataFrame({"pid": [pid]})

    events.groupBy("pid").applyInPandas(save, "pid long").count()
    return archives.archive_table(files.list_files(spark, root, "*.tar.gz"))


ARCHIVE_SQL = """WITH raw AS (
  SELECT event_id // 200 AS pid, event_id, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type,
         pid % 30 = 10 AS empty, pid % 7 = 0 AS cut, pid % 10 <> 0 AS two,
         NOT empty AND NOT (cut AND NOT two) AS visual, two AND NOT cut AS acoustic FROM events)"""


@query(
    "src_archive",
    f"""{ARCHIVE_SQL}
SELECT pid AS participant, 'visual' AS kind, count(*) + 1 AS "lines" FROM raw WHERE visual GROUP BY pid
UNION ALL SELECT pid, 'acoustic', count(*) + 1 FROM raw WHERE acoustic GROUP BY pid""",
)
def src_archive(spark, sf_dir):
    lines = archives.read_payload_lines(write_archives(spark, sf_dir))
    return lines.groupBy("participant", "kind").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "src_archive_listing",
    f"""{ARCHIVE_SQL}, firsts AS (
  SELECT DISTINCT pid, CAST(pid AS VARCHAR) || '_P.tar.gz' AS archive, empty, cut, two FROM raw
  ORDER BY archive LIMIT 3)
SELECT archive, CAST(pid AS VARCHAR) || '_OpenFace2.1.0_Pose_gaze_AUs.csv' AS member, NULL AS error
FROM firsts WHERE NOT empty
UNION ALL SELECT archive, CAST(pid AS VARCHAR) || '_OpenSMILE2.3.0_egemaps.csv', NULL FROM firsts WHERE two
UNION ALL SELECT archive, NULL, CASE WHEN empty THEN 'not a gzip file' ELSE 'unexpected end of data' END
FROM firsts WHERE empty OR cut""",
)
def src_archive_listing(spark, sf_dir):
    first = archives.first_archives(write_archives(spark, sf_dir))
    return archives.list_members(first)


EXTRACT_SQL = f"""{ARCHIVE_SQL}, outcome AS (
  SELECT pid, CASE WHEN visual AND acoustic THEN 'success' WHEN visual THEN 'partial' ELSE 'failed' END AS status,
         CASE WHEN visual THEN count(CASE WHEN event_id % 17 <> 0 THEN 1 END) END AS visual_len,
         CASE WHEN acoustic THEN count(*) END AS acoustic_len,
         CASE WHEN visual THEN 49 END::BIGINT AS visual_dim,
         CASE WHEN acoustic THEN 2 END::BIGINT AS acoustic_dim,
         CASE WHEN visual THEN avg(CASE WHEN event_id % 17 <> 0 THEN 1 - k / 100 END) END AS confidence_mean,
         concat_ws('; ',
           CASE WHEN empty THEN 'not a gzip file'
                WHEN cut THEN CAST(pid AS VARCHAR) || CASE WHEN two THEN '_OpenSMILE2.3.0_egemaps.csv'
                  ELSE '_OpenFace2.1.0_Pose_gaze_AUs.csv' END || ': unexpected end of data; unexpected end of data' END,
           CASE status WHEN 'partial' THEN 'partial_subject_recovered'
                WHEN 'failed' THEN 'no_required_features_recovered' END) AS warnings
  FROM raw GROUP BY pid, empty, cut, two, visual, acoustic)"""


@query(
    "src_extracted",
    f"""{EXTRACT_SQL}
SELECT pid || '_P' AS subject_id, status, visual_len, acoustic_len, visual_dim, acoustic_dim, warnings,
       round(confidence_mean, 5) AS confidence_mean FROM outcome""",
)
def src_extracted(spark, sf_dir):
    result = extraction.extract(write_archives(spark, sf_dir)).metadata
    return result.select(
        "subject_id",
        "status",
        "visual_len",
        "acoustic_len",
        long("visual_dim"),
        long("acoustic_dim"),
        F.array_join("warnings", "; ").alias("warnings"),
        r8("confidence_mean", digits=5),
    )


# --- reports --------------------------------------------------------------------------------------


@query(
    "src_reports",
    f"""{EXTRACT_SQL} SELECT pid || '_P' AS participant, status, warnings
FROM outcome WHERE status <> 'success'""",
)
def src_reports(spark, sf_dir):
    results = extraction.extract(write_archives(spark, sf_dir)).metadata
    path = new_shared_path(spark, "reports")
    # one report document per error: a report is never gathered into a single row
    entries = audit.extraction_errors(results).select(
        F.array(
            F.struct(
                F.col("subject_id").alias("participant"),
                "status",
                F.lit(None).cast("string").alias("error"),
                "warnings",
            )
        ).alias("errors")
    )
    entries.write.json(path)
    reports = spark.read.schema(readers.REPORT_SCHEMA).json(path)
    return reports.select(F.explode("errors").alias("e")).select(
        "e.participant", "e.status", F.array_join("e.warnings", "; ").alias("warnings")
    )


# --- delimited rows -------------------------------------------------------------------------------

# one value in 17 is unreadable; fields are padded with blanks, as are the header names
RAW_SQL = f"""WITH {frames_sql(DAY_MICROS)}, raw AS (
  SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'bad' ELSE 'ok' END AS state, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def raw_lines(spark, sf_dir):
    path = new_shared_path(spark, "payload-csv")
    events = table(spark, sf_dir, "events")
    stored = events.select(
        F.col("event_id").cast("string").alias(" event_id "),
        F.when(F.col("event_id") % 17 == 0, F.lit(" bad "))
        .otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
        .alias(" value"),
        F.get_json_object("props", "$.k").alias("k "),
    )
    writers.write_labels(stored, path, sep=";")
    return spark.read.csv(path, header=True, sep=";")


@query(
    "flt_bad_rows",
    f"{RAW_SQL} SELECT event_id, round(value, 8) AS value, k::DOUBLE AS k FROM raw WHERE state = 'ok'",
)
def flt_bad_rows(spark, sf_dir):
    clean = readers.trimmed_header(raw_lines(spark, sf_dir))
    rows = readers.numeric_rows(clean, ["event_id", "value", "k"])
    return rows.select(long("event_id"), r8("value"), r8("k"))


@query(
    "prj_trim_header",
    f"""{RAW_SQL} SELECT CAST(event_id AS VARCHAR) AS event_id, state, CAST(k AS VARCHAR) AS k FROM raw""",
)
def prj_trim_header(spark, sf_dir):
    clean = readers.trimmed_header(raw_lines(spark, sf_dir))
    value = F.trim("value")
    return clean.select(
        F.trim("event_id").alias("event_id"),
        F.when(value == "bad", F.lit("bad")).otherwise(F.lit("ok")).alias("state"),
        F.trim("k").alias("k"),
    )


@query(
    "chk_required_cols",
    f"""{RAW_SQL} SELECT 'confidence,timestamp' AS missing, count(*) AS "rows" FROM raw""",
)
def chk_required_cols(spark, sf_dir):
    clean = raw_lines(spark, sf_dir)
    missing = readers.missing_columns(clean.columns, ["event_id", "k", "timestamp", "confidence"])
    return clean.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "missing", F.lit(",".join(missing))
    )


@query(
    "set_missing_columns",
    """SELECT conv_id, turn, array_to_string(list_sort(list_filter(['user', 'assistant', 'system'],
       lambda r: r <> "role")), ',') AS missing FROM conversations""",
)
def set_missing_columns(spark, sf_dir):
    required = F.array(*[F.lit(r) for r in ("user", "assistant", "system")])
    missing = F.array_sort(F.array_except(required, F.array("role")))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(missing, ",").alias("missing")
    )


@query(
    "set_dedupe_ordered",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
       CASE WHEN l_returnflag = l_linestatus THEN l_returnflag || ',' || CAST(l_tax > 0.04 AS VARCHAR)
            ELSE l_returnflag || ',' || l_linestatus || ',' || CAST(l_tax > 0.04 AS VARCHAR) END AS warnings
FROM lineitem""",
)
def set_dedupe_ordered(spark, sf_dir):
    high = (F.col("l_tax") > 0.04).cast("string")
    repeated = F.array(
        "l_returnflag", "l_linestatus", high, F.col("l_linestatus"), F.col("l_returnflag"), high
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        long("l_linenumber"),
        F.array_join(F.array_distinct(repeated), ",").alias("warnings"),
    )


# --- sinks ----------------------------------------------------------------------------------------


@query("sink_manifest", MANIFEST_SQL)
def sink_manifest(spark, sf_dir):
    path = new_shared_path(spark, "manifest")
    rows = manifest_out(
        manifest.union_manifests(d_manifest(spark, sf_dir), e_manifest(spark, sf_dir))
    )
    writers.write_manifest(rows, path)
    return spark.read.schema(rows.schema).json(path).select(*MANIFEST_COLUMNS)


@query(
    "sink_audit",
    f"""{S}
SELECT 'fold' AS attribute, fold AS "value", count(*)::DOUBLE AS number FROM subjects GROUP BY fold
UNION ALL SELECT 'gender', gender, count(*)::DOUBLE FROM subjects GROUP BY gender
UNION ALL SELECT 'phq', 'min', min(phq)::DOUBLE FROM subjects
UNION ALL SELECT 'phq', 'max', max(phq)::DOUBLE FROM subjects
UNION ALL SELECT 'phq', 'mean', round(avg(phq), 6) FROM subjects
UNION ALL SELECT 'phq', 'median', median(phq)::DOUBLE FROM subjects
UNION ALL SELECT 'phq', 'std', round(stddev_pop(phq), 6) FROM subjects""",
)
def sink_audit(spark, sf_dir):
    path = new_shared_path(spark, "audit")
    labelled = subjects(spark, sf_dir)
    writers.write_audit(
        {
            "counts": audit.value_counts(labelled, ["fold", "gender"]),
            "phq": audit.numeric_stats(labelled, "phq"),
        },
        path,
    )
    counts = spark.read.schema("attribute string, value string, count long").json(f"{path}/counts")
    names = ("min", "max", "mean", "median", "std")
    phq = spark.read.schema(", ".join(f"{n} double" for n in names)).json(f"{path}/phq")
    figures = F.explode(F.array(*[F.struct(F.lit(n).alias("value"), r8(n, "number", digits=6)) for n in names]))
    return counts.select("attribute", "value", F.col("count").cast("double").alias("number")).unionByName(
        phq.select(F.lit("phq").alias("attribute"), figures.alias("f")).select("attribute", "f.value", "f.number")
    )


@query(
    "sink_features",
    f"""WITH {frames_sql()}
SELECT subject_id, modality, count(*) AS frames, round(sum(f0), 4) AS total FROM frames
GROUP BY subject_id, modality""",
)
def sink_features(spark, sf_dir):
    path = new_shared_path(spark, "features")
    writers.write_features(frames(spark, sf_dir).withColumn("corpus", F.lit("edaic")), path)
    back = spark.read.parquet(path).where(F.col("corpus") == "edaic")
    return back.groupBy("subject_id", "modality").agg(
        F.count(F.lit(1)).alias("frames"), r8(F.sum(F.col("features")[0]), "total", digits=4)
    )


@query(
    "sink_predictions",
    f"""{F4_MEAN}, {CONFUSION_SQL}
SELECT num_subjects, tn, fp, fn, tp, round(brier_score, 8) AS brier_score, {F1_SQL},
       (SELECT sum(num_windows)::BIGINT FROM subject_predictions) AS windows FROM confusion""",
)
def sink_predictions(spark, sf_dir):
    path = new_shared_path(spark, "predictions")
    writers.write_predictions(mean_subjects(spark, sf_dir), path)
    schema = (
        "num_subjects long, tn long, fp long, fn long, tp long, brier_score double, "
        "macro_f1 double, weighted_f1 double"
    )
    record = spark.read.schema(schema).json(f"{path}/metrics")
    saved = spark.read.csv(
        f"{path}/subject_predictions",
        header=True,
        schema="subject_id string, label int, num_windows long, probability double, prediction int",
    )
    one = F.lit(1).alias("one")
    windows = saved.agg(F.sum("num_windows").alias("windows")).select("windows", one)
    return record.select("*", one).join(windows, "one").select(
        "num_subjects", "tn", "fp", "fn", "tp",
        r8("brier_score"), r8("macro_f1"), r8("weighted_f1"), "windows",
    )


@query(
    "sink_incremental",
    """SELECT d.doc_id, n_chars, CASE WHEN l.doc_id IS NULL THEN 2 ELSE 1 END::BIGINT AS run
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""",
)
def sink_incremental(spark, sf_dir):
    path = new_shared_path(spark, "incremental")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    done = table(spark, sf_dir, "labels").select("doc_id").distinct()
    for run, todo in ((1, docs.join(done, "doc_id", "left_semi")), (2, docs), (3, docs)):
        result = writers.run_incremental(
            todo, path, ["doc_id"], lambda df, n=run: df.withColumn("run", F.lit(n).cast("long"))
        )
    return result




@query(
    "sink_incremental_files",
    """SELECT event_id, user_id, round(value * 2, 6) AS doubled FROM events""",
)
def sink_incremental_files(spark, sf_dir):
    root = new_shared_path(spark, "arriving")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    schema = "event_id long, user_id long, value double"
    for part in range(2):
        # a second delivery arrives between the runs; the third run finds nothing new
        events.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{root}/in")
        for _ in range(part + 1):
            append_new_files(
                spark,
                f"{root}/in",
                schema,
                f"{root}/out",
                f"{root}/state",
                lambda df: df.withColumn("doubled", F.col("value") * 2).drop("value"),
            )
    back = spark.read.parquet(f"{root}/out")
    return back.select("event_id", "user_id", r8("doubled", digits=6))
