"""Resampling, gaps, trimming, alignment, windows and normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import long, query, r8
from catalog.tables import (
    DAY_MICROS,
    FRAME_WIDTH,
    SIX_HOURS_MICROS,
    VECTOR_FRAMES_SQL,
    VECTOR_WIDTH,
    fold_by,
    fold_sql,
    frames,
    frames_sql,
    vector_frames,
)
from seqloom.functions import vectors
from seqloom.operators import normalise, sequence, windows
from seqloom.session import stored

KEYS = ("subject_id", "modality")


# --- shared steps, Spark --------------------------------------------------------------------------


def resampled(spark, sf_dir, bin_micros=DAY_MICROS):
    visual = F.col("modality") == "visual"
    rows = frames(spark, sf_dir, bin_micros).withColumns(
        {
            "confidence": F.when(visual, F.col("confidence")),
            "success": F.when(visual, F.col("success")),
        }
    )
    return sequence.resample(
        rows, FRAME_WIDTH, keys=KEYS, quality="confidence", success="success"
    )


def trimmed(spark, sf_dir, bin_micros=DAY_MICROS):
    """The bins are stored, so that finding the bounds does not aggregate the raw frames again."""
    return sequence.trim_invalid(stored(resampled(spark, sf_dir, bin_micros), "bins"), KEYS)


def _features():
    return [r8(F.col("features")[i], f"f{i}") for i in range(FRAME_WIDTH)]


# --- shared steps, SQL ----------------------------------------------------------------------------


def resampled_sql(bin_micros=DAY_MICROS):
    return f"""WITH {frames_sql(bin_micros)},
resampled AS (
  SELECT subject_id, modality, CAST(floor(ts) AS BIGINT) AS sec, avg(f0) AS f0, avg(f1) AS f1,
         CASE WHEN modality = 'acoustic' THEN TRUE
              ELSE avg(confidence) >= 0.5 AND avg(success) > 0.5 END AS valid
  FROM frames WHERE ts >= 0 GROUP BY subject_id, modality, CAST(floor(ts) AS BIGINT))"""


def trimmed_sql(bin_micros=DAY_MICROS):
    return f"""{resampled_sql(bin_micros)},
bounds AS (
  SELECT subject_id, modality, min(sec) AS lo, max(sec) AS hi
  FROM resampled WHERE valid GROUP BY subject_id, modality),
trimmed AS (
  SELECT r.subject_id, r.modality, sec - lo AS sec, f0, f1, valid
  FROM resampled r JOIN bounds b ON r.subject_id = b.subject_id AND r.modality = b.modality
  WHERE sec BETWEEN lo AND hi),
lens AS (
  SELECT subject_id, modality, max(sec) + 1 AS len FROM trimmed GROUP BY subject_id, modality)"""


def starts_sql(size, stride, source="lens"):
    """CTE ``starts``: every window, with the tail."""
    return f"""starts AS (
  SELECT subject_id, modality, unnest(list_sort(list_distinct(
           CASE WHEN len <= {size} THEN [0::BIGINT]
                ELSE list_concat(range(0, len - {size} + 1, {stride}), [len - {size}]) END))) AS start,
         least(len, {size}) AS win_len
  FROM {source})"""


def ratios_sql(size, stride, min_ratio):
    return f"""{starts_sql(size, stride)},
ratios AS (
  SELECT s.subject_id, s.modality, s.start, s.win_len,
         count(CASE WHEN t.valid THEN 1 END)::DOUBLE / s.win_len::DOUBLE AS valid_ratio
  FROM starts s LEFT JOIN trimmed t
    ON t.subject_id = s.subject_id AND t.modality = s.modality
   AND t.sec >= s.start AND t.sec < s.start + s.win_len
  GROUP BY s.subject_id, s.modality, s.start, s.win_len),
kept AS (SELECT * FROM ratios WHERE valid_ratio >= {min_ratio})"""


# --- resampling and gaps --------------------------------------------------------------------------


@query(
    "agg_resample",
    f"""{resampled_sql(SIX_HOURS_MICROS)}
SELECT subject_id, modality, sec, round(f0, 8) AS f0, round(f1, 8) AS f1, valid FROM resampled""",
)
def agg_resample(spark, sf_dir):
    return resampled(spark, sf_dir, SIX_HOURS_MICROS).select(*KEYS, "sec", *_features(), "valid")


@query(
    "win_gap_fill",
    f"""{resampled_sql(SIX_HOURS_MICROS)},
spine AS (
  SELECT subject_id, modality, unnest(range(0, max(sec) + 1)) AS sec
  FROM resampled GROUP BY subject_id, modality)
SELECT s.subject_id, s.modality, s.sec, round(coalesce(f0, 0), 8) AS f0, round(coalesce(f1, 0), 8) AS f1,
       coalesce(valid, FALSE) AS valid
FROM spine s LEFT JOIN resampled r
  ON r.subject_id = s.subject_id AND r.modality = s.modality AND r.sec = s.sec""",
)
def win_gap_fill(spark, sf_dir):
    dense = sequence.fill_gaps(resampled(spark, sf_dir, SIX_HOURS_MICROS), FRAME_WIDTH, KEYS)
    return dense.select(*KEYS, "sec", *_features(), "valid")


@query(
    "win_trim",
    f"""{trimmed_sql(SIX_HOURS_MICROS)}
SELECT subject_id, modality, sec, round(f0, 8) AS f0, round(f1, 8) AS f1, valid FROM trimmed""",
)
def win_trim(spark, sf_dir):
    return trimmed(spark, sf_dir, SIX_HOURS_MICROS).select(*KEYS, "sec", *_features(), "valid")


@query(
    "join_modalities",
    f"""{resampled_sql()},
lens AS (SELECT subject_id, modality, max(sec) + 1 AS len FROM resampled GROUP BY subject_id, modality),
common AS (
  SELECT subject_id, min(len) AS len FROM lens GROUP BY subject_id HAVING count(*) = 2),
cut AS (
  SELECT r.* FROM resampled r JOIN common c ON r.subject_id = c.subject_id AND r.sec < c.len)
SELECT subject_id, sec,
       round(coalesce(max(CASE WHEN modality = 'visual' THEN f0 END), 0), 8) AS v0,
       round(coalesce(max(CASE WHEN modality = 'visual' THEN f1 END), 0), 8) AS v1,
       round(coalesce(max(CASE WHEN modality = 'acoustic' THEN f0 END), 0), 8) AS a0,
       round(coalesce(max(CASE WHEN modality = 'acoustic' THEN f1 END), 0), 8) AS a1,
       coalesce(bool_or(CASE WHEN modality = 'visual' THEN valid END), FALSE)
       AND coalesce(bool_or(CASE WHEN modality = 'acoustic' THEN valid END), FALSE) AS valid
FROM cut GROUP BY subject_id, sec""",
)
def join_modalities(spark, sf_dir):
    both = aligned(spark, sf_dir)
    return both.select(
        "subject_id",
        "sec",
        *[r8(F.col("visual")[i], f"v{i}") for i in range(FRAME_WIDTH)],
        *[r8(F.col("acoustic")[i], f"a{i}") for i in range(FRAME_WIDTH)],
        "valid",
    )


def aligned(spark, sf_dir, bin_micros=DAY_MICROS):
    seq = stored(resampled(spark, sf_dir, bin_micros), "bins")
    visual, acoustic = (
        seq.where(F.col("modality") == m).drop("modality") for m in ("visual", "acoustic")
    )
    return sequence.align(visual, acoustic, (FRAME_WIDTH, FRAME_WIDTH))


@query(
    "flt_min_len",
    f"""{trimmed_sql()}
SELECT t.subject_id, t.modality, t.sec FROM trimmed t JOIN lens l
  ON l.subject_id = t.subject_id AND l.modality = t.modality WHERE len >= 28""",
)
def flt_min_len(spark, sf_dir):
    return sequence.drop_short(trimmed(spark, sf_dir), 28, KEYS).select(*KEYS, "sec")


@query(
    "flt_max_len",
    f"""{resampled_sql(SIX_HOURS_MICROS)}
SELECT subject_id, modality, max(sec) + 1 AS len, count(*) AS filled
FROM resampled WHERE sec < 60 GROUP BY subject_id, modality""",
)
def flt_max_len(spark, sf_dir):
    seq = sequence.cap_length(resampled(spark, sf_dir, SIX_HOURS_MICROS), 60)
    return seq.groupBy(*KEYS).agg(
        (F.max("sec") + 1).alias("len"), F.count(F.lit(1)).alias("filled")
    )


# --- windows --------------------------------------------------------------------------------------

SIZE, STRIDE, RATIO = 9, 4, 0.3


@query(
    "win_sliding",
    f"""{trimmed_sql(SIX_HOURS_MICROS)}
SELECT subject_id, modality, unnest(range(0, len - {SIZE} + 1, {STRIDE})) AS start
FROM lens WHERE len > {SIZE}""",
)
def win_sliding(spark, sf_dir):
    lens = sequence.lengths(trimmed(spark, sf_dir, SIX_HOURS_MICROS), KEYS)
    index = windows.window_index(lens.where(F.col("len") > SIZE), SIZE, STRIDE, KEYS, tail=False)
    return index.select(*KEYS, "start")


@query(
    "win_tail_anchor",
    f"""{trimmed_sql(SIX_HOURS_MICROS)}, {starts_sql(SIZE, STRIDE)}
SELECT subject_id, modality, row_number() OVER (PARTITION BY subject_id, modality ORDER BY start) - 1 AS window_idx,
       start, win_len FROM starts""",
)
def win_tail_anchor(spark, sf_dir):
    lens = sequence.lengths(trimmed(spark, sf_dir, SIX_HOURS_MICROS), KEYS)
    return windows.window_index(lens, SIZE, STRIDE, KEYS)


@query(
    "win_short_seq",
    f"""{trimmed_sql()}
SELECT subject_id, modality, 0::BIGINT AS start, len AS win_len FROM lens WHERE len <= 30""",
)
def win_short_seq(spark, sf_dir):
    lens = sequence.lengths(trimmed(spark, sf_dir), KEYS)
    index = windows.window_index(lens, 30, 15, KEYS)
    short = lens.where(F.col("len") <= 30).select(*KEYS)
    return index.join(short, list(KEYS), "left_semi").select(*KEYS, "start", "win_len")


def kept_windows(spark, sf_dir, size=SIZE, stride=STRIDE, ratio=RATIO, bin_micros=SIX_HOURS_MICROS):
    seq = stored(trimmed(spark, sf_dir, bin_micros), "trimmed")
    lens = sequence.lengths(seq, KEYS)
    return seq, lens, windows.valid_ratio(seq, lens, size, stride, ratio, KEYS)


@query(
    "agg_valid_ratio",
    f"""{trimmed_sql(SIX_HOURS_MICROS)}, {ratios_sql(SIZE, STRIDE, 0.0)}
SELECT subject_id, modality, start, win_len, round(valid_ratio, 8) AS valid_ratio FROM kept""",
)
def agg_valid_ratio(spark, sf_dir):
    _, _, kept = kept_windows(spark, sf_dir, ratio=0.0)
    return kept.select(*KEYS, "start", "win_len", r8("valid_ratio"))


@query(
    "flt_valid_ratio",
    f"""{trimmed_sql(SIX_HOURS_MICROS)}, {ratios_sql(SIZE, STRIDE, 0.5)}
SELECT subject_id, modality, start, win_len, round(valid_ratio, 8) AS valid_ratio FROM kept""",
)
def flt_valid_ratio(spark, sf_dir):
    _, _, kept = kept_windows(spark, sf_dir, ratio=0.5)
    return kept.select(*KEYS, "start", "win_len", r8("valid_ratio"))


@query(
    "win_index",
    f"""{trimmed_sql(SIX_HOURS_MICROS)}, {ratios_sql(SIZE, STRIDE, RATIO)}
SELECT subject_id, modality, start,
       row_number() OVER (PARTITION BY subject_id, modality ORDER BY start) - 1 AS window_idx FROM kept""",
)
def win_index(spark, sf_dir):
    _, _, kept = kept_windows(spark, sf_dir)
    return windows.number_windows(kept, STRIDE, KEYS).select(*KEYS, "start", "window_idx")


@query(
    "join_window_frames",
    f"""{trimmed_sql(SIX_HOURS_MICROS)}, {ratios_sql(SIZE, STRIDE, RATIO)}
SELECT k.subject_id, k.modality, k.start, t.sec - k.start AS "offset", round(t.f0, 8) AS f0, round(t.f1, 8) AS f1
FROM kept k JOIN trimmed t ON t.subject_id = k.subject_id AND t.modality = k.modality
 AND t.sec >= k.start AND t.sec < k.start + k.win_len""",
)
def join_window_frames(spark, sf_dir):
    seq, lens, kept = kept_windows(spark, sf_dir)
    placed = windows.assign_windows(seq, lens, SIZE, STRIDE, KEYS)
    joined = placed.join(kept.select(*KEYS, "start"), [*KEYS, "start"])
    return joined.select(*KEYS, "start", long("offset"), *_features())


def matrix_sql(size, stride, ratio, padded):
    rows = str(size) if padded else "win_len"
    return f"""{trimmed_sql()}, {ratios_sql(size, stride, ratio)},
cells AS (
  SELECT subject_id, modality, start, win_len, unnest(range(0, {rows})) AS row FROM kept),
matrix AS (
  SELECT c.subject_id, c.modality, c.start, c.row, c.win_len,
         coalesce(t.f0, 0) AS f0, coalesce(t.f1, 0) AS f1
  FROM cells c LEFT JOIN trimmed t ON t.subject_id = c.subject_id AND t.modality = c.modality
   AND t.sec = c.start + c.row AND c.row < c.win_len)"""


def _matrix(spark, sf_dir, size, stride, ratio, pad):
    seq, lens, kept = kept_windows(spark, sf_dir, size, stride, ratio, DAY_MICROS)
    return windows.to_matrix(
        kept, seq, lens, size, stride, {"features": FRAME_WIDTH}, keys=KEYS, pad=pad
    )


def _matrix_rows(matrix):
    rows = matrix.select(*KEYS, "start", F.posexplode("features").alias("row", "features"))
    return rows.select(*KEYS, "start", long("row"), *_features())


_MATRIX_OUT = """
SELECT subject_id, modality, start, row, round(f0, 8) AS f0, round(f1, 8) AS f1 FROM matrix"""


@query("win_collect", matrix_sql(SIZE, STRIDE, 0.5, False) + _MATRIX_OUT)
def win_collect(spark, sf_dir):
    return _matrix_rows(_matrix(spark, sf_dir, SIZE, STRIDE, 0.5, pad=False))


@query("win_pad", matrix_sql(30, 15, 0.5, True) + _MATRIX_OUT)
def win_pad(spark, sf_dir):
    return _matrix_rows(_matrix(spark, sf_dir, 30, 15, 0.5, pad=True))


@query(
    "win_pad_mask",
    matrix_sql(30, 15, 0.5, True)
    + """
SELECT subject_id, modality, start, count(CASE WHEN f0 <> 0 OR f1 <> 0 THEN 1 END) AS real_rows,
       count(*) AS rows FROM matrix GROUP BY subject_id, modality, start""",
)
def win_pad_mask(spark, sf_dir):
    matrix = _matrix(spark, sf_dir, 30, 15, 0.5, pad=True)
    mask = windows.pad_mask(F.col("features"))
    return matrix.select(
        *KEYS,
        "start",
        long(F.size(F.filter(mask, lambda m: m)), "real_rows"),
        long(F.size("features"), "rows"),
    )


# --- normalisation --------------------------------------------------------------------------------

STATS_SQL = f"""{trimmed_sql()},
train AS (SELECT *, {fold_sql('subject_id')} AS fold FROM trimmed),
stats AS (
  SELECT modality, 0 AS dim, avg(f0) AS mean, sqrt(greatest(var_pop(f0), 1e-8)) AS std
  FROM train WHERE fold = 'train' AND valid GROUP BY modality
  UNION ALL
  SELECT modality, 1, avg(f1), sqrt(greatest(var_pop(f1), 1e-8))
  FROM train WHERE fold = 'train' AND valid GROUP BY modality)"""


def frame_stats(spark, sf_dir, seq=None):
    seq = trimmed(spark, sf_dir) if seq is None else seq
    train = seq.where(fold_by(F.col("subject_id")) == "train")
    return normalise.fit_stats(train, FRAME_WIDTH, by=["modality"])


def normalised(spark, sf_dir):
    seq = stored(trimmed(spark, sf_dir), "trimmed")
    return normalise.apply_stats(seq, frame_stats(spark, sf_dir, seq), ["modality"])


@query(
    "agg_norm_stats",
    STATS_SQL
    + """
SELECT modality, dim::BIGINT AS dim, round(mean, 6) AS mean, round(std, 6) AS std FROM stats""",
)
def agg_norm_stats(spark, sf_dir):
    stats = normalise.stats_long(frame_stats(spark, sf_dir), ["modality"])
    return stats.select("modality", long("dim"), r8("mean", digits=6), r8("std", digits=6))


VECTOR_STATS_SQL = f"""WITH {VECTOR_FRAMES_SQL},
long_frames AS (
  SELECT subject_id, sec, fold, label, unnest(range(0, len(features))) AS dim,
         unnest(features)::DOUBLE AS x
  FROM vector_frames),
stats AS (
  SELECT dim, avg(x) AS mean, sqrt(greatest(var_pop(x), 1e-8)) AS std
  FROM long_frames WHERE fold = 'train' GROUP BY dim)"""


def vector_stats(spark, sf_dir):
    train = vector_frames(spark, sf_dir).where(F.col("fold") == "train")
    return normalise.fit_stats(train, VECTOR_WIDTH, valid_only=False)


@query(
    "agg_norm_stats_wide",
    VECTOR_STATS_SQL
    + " SELECT dim::BIGINT AS dim, round(mean, 6) AS mean, round(std, 6) AS std FROM stats",
)
def agg_norm_stats_wide(spark, sf_dir):
    stats = normalise.stats_long(vector_stats(spark, sf_dir))
    return stats.select(long("dim"), r8("mean", digits=6), r8("std", digits=6))


@query(
    "join_stats",
    STATS_SQL
    + """
SELECT t.subject_id, t.modality, t.sec, round(a.mean, 6) AS mean0, round(b.std, 6) AS std1
FROM trimmed t JOIN stats a ON a.modality = t.modality AND a.dim = 0
JOIN stats b ON b.modality = t.modality AND b.dim = 1""",
)
def join_stats(spark, sf_dir):
    seq = stored(trimmed(spark, sf_dir), "trimmed")
    joined = normalise.join_stats(seq, frame_stats(spark, sf_dir, seq), ["modality"])
    return joined.select(
        *KEYS,
        "sec",
        r8(F.col("mean")[0], "mean0", digits=6),
        r8(F.col("std")[1], "std1", digits=6),
    )


@query(
    "prj_normalise",
    STATS_SQL
    + """
SELECT t.subject_id, t.modality, t.sec, round((f0 - a.mean) / a.std, 6) AS z0,
       round((f1 - b.mean) / b.std, 6) AS z1
FROM trimmed t JOIN stats a ON a.modality = t.modality AND a.dim = 0
JOIN stats b ON b.modality = t.modality AND b.dim = 1""",
)
def prj_normalise(spark, sf_dir):
    scaled = normalised(spark, sf_dir)
    return scaled.select(
        *KEYS, "sec", *[r8(F.col("features")[i], f"z{i}", digits=6) for i in range(FRAME_WIDTH)]
    )


@query(
    "prj_normalise_wide",
    VECTOR_STATS_SQL
    + """
SELECT subject_id, sec, dim::BIGINT AS dim, round((x - mean) / std, 5) AS z
FROM long_frames JOIN stats USING (dim)""",
)
def prj_normalise_wide(spark, sf_dir):
    stats = vector_stats(spark, sf_dir).withColumn("valid", F.lit(True))
    scaled = normalise.apply_stats(vector_frames(spark, sf_dir), stats, ["valid"])
    return scaled.select("subject_id", "sec", F.posexplode("features").alias("dim", "z")).select(
        "subject_id", "sec", long("dim"), r8("z", digits=5)
    )


@query(
    "chk_nan_normalised",
    STATS_SQL
    + """
SELECT t.modality, coalesce(bool_or(isnan((f0 - a.mean) / a.std) OR isnan((f1 - b.mean) / b.std)), FALSE) AS has_nan
FROM trimmed t JOIN stats a ON a.modality = t.modality AND a.dim = 0
JOIN stats b ON b.modality = t.modality AND b.dim = 1 GROUP BY t.modality""",
)
def chk_nan_normalised(spark, sf_dir):
    scaled = normalised(spark, sf_dir)
    return normalise.normalised_has_nan(scaled, ["modality"])


@query(
    "chk_stats_meta",
    STATS_SQL
    + """
SELECT modality, 'train' AS source, count(mean) AS mean_dims, count(std) AS std_dims
FROM stats GROUP BY modality""",
)
def chk_stats_meta(spark, sf_dir):
    stats = normalise.stats_long(frame_stats(spark, sf_dir), ["modality"])
    return normalise.stats_shape(
        stats.withColumn("source", F.lit("train")), ["modality", "source"]
    )


@query(
    "prj_feature_vector",
    f"""WITH {frames_sql()}
SELECT subject_id, modality, round(ts, 6)::DOUBLE AS ts, round(f0::FLOAT::DOUBLE, 4) AS x0,
       round(f1::FLOAT::DOUBLE, 4) AS x1 FROM frames""",
)
def prj_feature_vector(spark, sf_dir):
    flat = frames(spark, sf_dir).select(
        *KEYS, "ts", *[F.col("features")[i].alias(f"f{i}") for i in range(FRAME_WIDTH)]
    )
    packed = flat.withColumn("features", vectors.feature_vector(["f0", "f1"]))
    return packed.select(
        *KEYS,
        F.round("ts", 6).cast("double").alias("ts"),
        *[
            r8(F.col("features")[i].cast("double"), f"x{i}", digits=4)
            for i in range(FRAME_WIDTH)
        ],
    )
