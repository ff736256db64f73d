"""The corpus operators as registered queries over the driver tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import (
    bpe,
    decontaminate,
    fim,
    html,
    lines,
    lm,
    negatives,
    quality,
    simhash,
    substrings,
    tokencount,
    urls,
    warc,
)

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}

#: The rules of the URL query (host, path, rule, verdict).
URL_RULES = (
    ("net", "/", "net/", "block"),
    ("example.net", "/en/", "example.net/en/", "allow"),
    ("example.com", "/de/", "example.com/de/", "block"),
    ("org", "/fr/", "org/fr/", "allow"),
)


def query(name: str, sql: str | None = None):
    def register(fn):
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs.select("doc_id", "text"), rules).select(
        "doc.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "rule",
    )


def _values(rules) -> str:
    return ", ".join("('" + "', '".join(rule) + "')" for rule in rules)


@query(
    "op3_url_filter",
    f"""
    WITH p AS (
      SELECT page_id,
             coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
      FROM pages),
    r(rule_host, rule_path, rule, verdict) AS (VALUES {_values(URL_RULES)})
    SELECT page_id, host, path,
           (SELECT arg_max(rule, length(rule)) FROM r
            WHERE (p.host = rule_host OR ends_with(p.host, '.' || rule_host))
              AND starts_with(p.path, rule_path)) AS rule,
           coalesce((SELECT arg_max(verdict, length(rule)) FROM r
            WHERE (p.host = rule_host OR ends_with(p.host, '.' || rule_host))
              AND starts_with(p.path, rule_path)), 'allow') AS verdict
    FROM p
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {_values(URL_RULES)} AS r(host, path, rule, verdict)")
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules)


@query(
    "op4_line_dedup",
    """
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
    k AS (SELECT doc_id, line, pos,
                 translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
          FROM l),
    c AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20
          GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    m AS (SELECT k.doc_id, k.line, k.pos, c.key IS NOT NULL AND k.doc_id <> c.holder AS gone
          FROM k LEFT JOIN c USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query("op2_benchmark_leaks")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )


@query("op5_lm_scores")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.withColumn(
        "n_tokens", tokencount.count_tokens(spark, F.col("text"), public_tokenizers.path("word_bpe_49k.json"))
    )
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 2048).alias("over_limit"),
    )


@query("op7_html_extraction")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", html.extract(F.col("html")).alias("text")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


@query("op8_simhash_near_duplicates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_substring_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_bpe_round_trip")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = bpe.digest(F.col("text"), public_tokenizers.path("byte_bpe_50k.json"))
    return docs.select("doc_id", digest.alias("d")).select("doc_id", "d.*")


@query(
    "op11_hard_negatives",
    """
    WITH v AS (
      SELECT row_number() OVER () AS r, vec_id,
             CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
             CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r),
    p AS (
      SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score,
             row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS nth
      FROM s WHERE same QUALIFY nth <= 5),
    n AS (
      SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.r, nth ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s USING (r)
      WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
      QUALIFY rank <= 3)
    SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    return negatives.mine(
        table(spark, sf_dir, "embeddings"),
        vec_id,
        F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label),
        F.col("embedding"),
        F.col("id") % 50 == 0,
    )


@query(
    "op12_warc_round_trip",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (
      SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex,
             row_number() OVER same AS nth, first_value(page_id) OVER same AS first_id
      FROM p
      WINDOW same AS (PARTITION BY html ORDER BY page_id NULLS LAST))
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
           -- five hex digits are four digits of five bits
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             1 + CAST((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT)
                       >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
           CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN nth > 1 THEN first_id END AS refers_to
    FROM d
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(table(spark, sf_dir, "pages"), F.col("page_id"), F.col("html"))
    records = warc.resolve(warc.read_archives(spark, path, with_data=False))
    return records.select(
        warc.urn_id(F.col("record_id")).cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.urn_id(F.col("refers_to")).cast("long").alias("refers_to"),
    )


@query(
    "op13_fill_in_middle",
    r"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
      FROM documents),
    u AS (
      SELECT doc_id, t,
             regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
             CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
      FROM d),
    c AS (
      SELECT *, len(units) AS n,
             least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
             greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                    OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
      FROM u),
    p AS (
      SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid,
             array_to_string(units[b + 1:n], '') AS suf
      FROM c)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form,
           CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t
                  WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                  ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM p
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", fim.transform(F.col("text"), F.col("doc_id")).alias("f")).select(
        "doc_id",
        "f.n",
        "f.form",
        "f.prefix_chars",
        "f.middle_chars",
        F.sha2("f.output", 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("f.output"), F.col("f.form")), 256).alias("restored_sha256"),
    )


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
