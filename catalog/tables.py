"""Inputs derived from the driver tables: the Spark form and the SQL form of each, side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000.0
SIX_HOURS_MICROS = 21_600_000_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- irregular two-modality frames with quality, from events --------------------------------------

FRAME_WIDTH = 2


def frames(spark: SparkSession, sf_dir: str, bin_micros: float = DAY_MICROS) -> DataFrame:
    """One row per frame; one unit of ``ts`` is one bin of ``bin_micros``."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject_id"),
        F.when(F.col("event_type").isin("purchase", "signup"), F.lit("acoustic"))
        .otherwise(F.lit("visual"))
        .alias("modality"),
        (micros / F.lit(bin_micros)).cast("float").alias("ts"),
        F.array(F.col("value"), k).alias("features"),
        (F.lit(1.0) - k / F.lit(100.0)).alias("confidence"),
        F.when(F.col("event_type") == "error", F.lit(0)).otherwise(F.lit(1)).alias("success"),
    )


def frames_sql(bin_micros: float = DAY_MICROS) -> str:
    return f"""frames AS (
  SELECT user_id AS subject_id,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'acoustic' ELSE 'visual' END AS modality,
         CAST((epoch_us(ts) - 1704067200000000) / {bin_micros:.1f}::DOUBLE AS FLOAT) AS ts,
         value AS f0,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS f1,
         1.0::DOUBLE - CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0::DOUBLE AS confidence,
         CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS success
  FROM events)"""


def fold_by(key):
    digit = key % 10
    return (
        F.when(digit < 7, F.lit("train")).when(digit == 7, F.lit("dev")).otherwise(F.lit("test"))
    )


def fold_sql(key: str) -> str:
    return f"CASE WHEN {key} % 10 < 7 THEN 'train' WHEN {key} % 10 = 7 THEN 'dev' ELSE 'test' END"


# --- fixed-width vector frames, from embeddings ---------------------------------------------------

VECTOR_WIDTH = 64


def vector_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of ten 64-wide frames."""
    subject = F.floor(F.col("vec_id") / 10).cast("long")
    return table(spark, sf_dir, "embeddings").select(
        subject.alias("subject_id"),
        (F.col("vec_id") % 10).alias("sec"),
        F.col("embedding").alias("features"),
        F.lit(True).alias("valid"),
        fold_by(subject).alias("fold"),
        (subject % 2).cast("int").alias("label"),
    )


VECTOR_FRAMES_SQL = f"""vector_frames AS (
  SELECT vec_id // 10 AS subject_id, vec_id % 10 AS sec, embedding AS features,
         {fold_sql('(vec_id // 10)')} AS fold, CAST((vec_id // 10) % 2 AS INTEGER) AS label
  FROM embeddings)"""


# --- labelled subjects, from customer -------------------------------------------------------------


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("subject_id"),
        fold_by(key).alias("fold"),
        (F.col("c_acctbal") < 0).cast("int").alias("label_binary"),
        F.when(F.col("c_acctbal") < 0, F.lit("depression")).otherwise(F.lit("normal")).alias("label"),
        F.col("c_mktsegment").alias("gender"),
        (key % 60 + 10).cast("int").alias("age"),
        (key % 25).cast("int").alias("phq"),
        F.col("c_acctbal").alias("duration"),
    )


SUBJECTS_SQL = f"""subjects AS (
  SELECT c_custkey AS subject_id, {fold_sql('c_custkey')} AS fold,
         CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS label_binary,
         CASE WHEN c_acctbal < 0 THEN 'depression' ELSE 'normal' END AS label,
         c_mktsegment AS gender, c_custkey % 60 + 10 AS age, c_custkey % 25 AS phq,
         c_acctbal AS duration
  FROM customer)"""


# --- window predictions, from lineitem and orders -------------------------------------------------


def window_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount"
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_custkey", "o_orderpriority"
    )
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").cast("string").alias("subject_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.col("l_linenumber").alias("window_idx"),
        (F.col("l_quantity") / F.lit(50.0)).alias("window_probability"),
        (F.col("l_discount") * F.lit(10.0)).alias("edge_probability"),
        F.concat(F.lit("track_"), (F.col("o_custkey") % 4).cast("string")).alias("track"),
        F.col("o_orderpriority").alias("candidate"),
        (F.col("l_orderkey") % 5).alias("seed"),
        (F.col("l_orderkey") % 7 + 1).alias("epoch"),
    )


WINDOW_PREDICTIONS_SQL = """window_predictions AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS subject_id,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
         l_linenumber AS window_idx, l_quantity / 50.0::DOUBLE AS window_probability,
         l_discount * 10.0::DOUBLE AS edge_probability,
         'track_' || (o_custkey % 4) AS track, o_orderpriority AS candidate,
         l_orderkey % 5 AS seed, l_orderkey % 7 + 1 AS epoch
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

# SQL form of the three window-to-subject methods, for any key list
SCORE_SQL = {
    "mean": "round(avg(window_probability), 12)",
    "attention": (
        "round(sum(window_probability * exp(window_probability)) / sum(exp(window_probability)), 12)"
    ),
    "topk": (
        "round(list_sum(list_sort(list(window_probability), 'DESC')"
        "[1:greatest(1, ceil(count(*) * 0.25))::BIGINT]) / greatest(1, ceil(count(*) * 0.25)), 12)"
    ),
}


def p8_sql(expression: str) -> str:
    """A twelve-digit probability at eight digits, halves up in decimal as Spark rounds them."""
    return f"round(CAST({expression} AS DECIMAL(18, 12)), 8)::DOUBLE"


def subject_predictions_sql(
    method: str = "mean", keys: str = "subject_id", source: str = "window_predictions"
) -> str:
    """CTE ``subject_predictions`` for one method."""
    return f"""scored AS (
  SELECT {keys}, min(label) AS label, count(*) AS num_windows, {SCORE_SQL[method]} AS probability
  FROM {source} GROUP BY {keys}),
subject_predictions AS (
  SELECT *, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS prediction FROM scored)"""


F4_MEAN = f"WITH {WINDOW_PREDICTIONS_SQL},\n{subject_predictions_sql()}"
