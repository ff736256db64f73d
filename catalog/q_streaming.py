"""Streams: closed sliding windows and smoothed risk states, from the events as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, r8
from catalog.tables import table
from seqloom.session import new_shared_path, register
from seqloom.streaming import run, smoothing, windows


def event_stream(spark, sf_dir):
    """The events table as a stream of its files; event times must be instants, here those of UTC."""
    schema = table(spark, sf_dir, "events").schema
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    # a pattern: a stream takes a plain path for a folder, and the table may be one file
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.timestamp_micros(micros))


def streamed(spark, stream):
    """What a stream gives for all input present, from its files."""
    path, state = (register(new_shared_path(spark, f"stream-{n}")) for n in ("out", "state"))
    run.append_available(stream, path, state)
    return spark.read.schema(stream.schema).parquet(path)


@query(
    "opt_stream_windows",
    """WITH placed AS (
  SELECT event_type, value, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - i * INTERVAL 6 HOURS AS start
  FROM events, (SELECT unnest(range(0, 4)) AS i)),
closed AS (SELECT max(ts) - INTERVAL 1 HOUR AS watermark FROM events)
SELECT epoch(start)::BIGINT AS start, epoch(start)::BIGINT + 86400 AS "end", event_type, count(*) AS events,
       round(avg(value), 8) AS mean, min(value) AS low, max(value) AS high
FROM placed, closed GROUP BY start, event_type, watermark HAVING start + INTERVAL 1 DAY <= date_trunc('milliseconds', watermark)""",
)
def opt_stream_windows(spark, sf_dir):
    found = streamed(spark, windows.sliding_windows(event_stream(spark, sf_dir), ["event_type"], "value"))
    ends = [F.unix_seconds(c).alias(c) for c in ("start", "end")]
    return found.select(*ends, "event_type", "events", r8("mean"), "low", "high")


RULE = smoothing.Smoothing()
SMOOTHED_SQL = f"""WITH RECURSIVE watermark AS (
  SELECT (max(epoch_us(ts)) // 1000 - 3600000) * 1000 AS reached FROM events),
rows AS (
  SELECT user_id::VARCHAR AS subject_id, epoch_us(ts) AS micros, event_type <> 'error' AS valid,
         json_extract_string(props, '$.k')::DOUBLE / 100.0::DOUBLE AS probability
  FROM events, watermark WHERE epoch_us(ts) <= reached),
seq AS (
  SELECT *, coalesce(micros - lag(micros) OVER w > {RULE.timeout_seconds * 1_000_000}, TRUE) AS anew,
         row_number() OVER w AS n
  FROM rows WINDOW w AS (PARTITION BY subject_id ORDER BY micros, valid, probability)),
walk AS (
  SELECT subject_id, 0::BIGINT AS n, 0::BIGINT AS micros, NULL::DOUBLE AS probability, NULL::DOUBLE AS ema,
         0 AS evidence, 0 AS above, 0 AS below, FALSE AS elevated FROM seq WHERE n = 1
  UNION ALL
  SELECT subject_id, n, micros, probability, ema, evidence, above, below,
         CASE WHEN elevated THEN below < {RULE.persist} ELSE above >= {RULE.persist} AND evidence >= {RULE.evidence} END
  FROM (
    SELECT subject_id, n, micros, probability, ema, CASE WHEN valid THEN evidence + 1 ELSE 0 END AS evidence,
           CASE WHEN valid AND ema >= {RULE.up}::DOUBLE THEN above + 1 ELSE 0 END AS above,
           CASE WHEN valid AND ema <= {RULE.down}::DOUBLE THEN below + 1 ELSE 0 END AS below, elevated
    FROM (
      SELECT s.subject_id, s.n, s.micros, s.probability, s.valid,
             CASE WHEN NOT valid THEN CASE WHEN NOT anew THEN ema END
                  WHEN anew OR ema IS NULL THEN s.probability
                  ELSE {RULE.alpha}::DOUBLE * s.probability + (1.0::DOUBLE - {RULE.alpha}::DOUBLE) * ema END AS ema,
             CASE WHEN anew THEN 0 ELSE evidence END AS evidence, CASE WHEN anew THEN 0 ELSE above END AS above,
             CASE WHEN anew THEN 0 ELSE below END AS below, elevated AND NOT anew AS elevated
      FROM walk w JOIN seq s ON s.subject_id = w.subject_id AND s.n = w.n + 1)))
SELECT subject_id, micros, round(probability, 8) AS probability, ema,
       evidence::BIGINT AS evidence, CASE WHEN evidence < {RULE.evidence} THEN 'insufficient'
       WHEN elevated THEN 'elevated' ELSE 'normal' END AS state
FROM walk WHERE n > 0"""


@query("opt_stream_smoothing", SMOOTHED_SQL)
def opt_stream_smoothing(spark, sf_dir):
    stream = smoothing.smoothed(
        event_stream(spark, sf_dir),
        F.col("user_id"),
        "ts",
        F.get_json_object("props", "$.k").cast("double") / 100.0,
        F.col("event_type") != "error",
    )
    return streamed(spark, stream).select(
        "subject_id", "micros", r8("probability"), "ema", F.col("evidence").cast("long").alias("evidence"), "state"
    )
