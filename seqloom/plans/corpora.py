"""From frames and labels to normalised, padded windows, in the order each corpus asks for."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.vectors import standardise
from seqloom.operators import model, normalise, sequence, windows
from seqloom.operators.skew import join_spread
from seqloom.session import checkpointed, stored

KEYS = ("subject_id",)
MODALITIES = ("visual", "acoustic")


@dataclass(frozen=True)
class WindowConfig:
    size: int = 30
    stride: int = 15
    min_len: int = 15
    min_valid_ratio: float = 0.5
    quality_threshold: float = 0.5
    max_len: int = 3600
    normalize: bool = True


@dataclass
class Prepared:
    """Sequences of labelled subjects with one feature column per modality, and what follows."""

    seq: DataFrame
    lengths: DataFrame
    stats: DataFrame | None
    widths: dict[str, int]


def train_stats(
    train: DataFrame, widths: Mapping[str, int], valid_only: bool, provided: DataFrame | None
) -> DataFrame:
    """``modality, mean, std``: from the train fold, unless given."""
    if provided is not None:
        return provided
    parts = [
        normalise.fit_stats(train, width, features=name, valid_only=valid_only).select(
            F.lit(name).alias("modality"), "mean", "std"
        )
        for name, width in widths.items()
    ]
    return checkpointed(reduce(lambda a, b: a.unionByName(b), parts))


def prepare_e(
    frames: Mapping[str, DataFrame],
    widths: Mapping[str, int],
    labels: DataFrame,
    modality: str,
    config: WindowConfig = WindowConfig(),
    stats: DataFrame | None = None,
) -> Prepared:
    """Resample, align, trim, drop short sequences; statistics over valid train bins.

    ``frames``: per modality ``subject_id, ts, features`` and, for the visual one, ``confidence,
    success``. The prepared sequences are materialised: four later steps read them.
    """
    if modality not in (*MODALITIES, "both"):
        raise ValueError(f"No frames are kept under the name {modality}")
    names = list(MODALITIES) if modality == "both" else [modality]
    binned = {}
    for name in names:
        quality = (
            {"quality": "confidence", "success": "success"} if name == "visual" else {}
        )
        # raw frames are read once: lengths, bounds and bins all come from the stored bins
        binned[name] = stored(
            sequence.resample(
                frames[name], widths[name], quality_threshold=config.quality_threshold, **quality
            ),
            f"bins-{name}",
        )
    if modality == "both":
        seq = sequence.align(
            binned["visual"], binned["acoustic"], (widths["visual"], widths["acoustic"]), MODALITIES
        )
    else:
        seq = binned[modality].withColumnRenamed("features", modality)
    # length filter and labels act on the one-row-per-subject bounds: the bins are joined once
    bounds = (
        sequence.valid_bounds(seq)
        .withColumn("len", F.col("last") - F.col("first") + 1)
        .where(F.col("len") >= config.min_len)
        .join(labels.select("subject_id", "fold"), "subject_id")
    )
    ready = stored(sequence.cut_to(seq, bounds), "sequences")
    used = {n: widths[n] for n in names}
    fitted = (
        train_stats(ready.where(F.col("fold") == "train"), used, True, stats)
        if config.normalize
        else None
    )
    return Prepared(ready, ready.groupBy("subject_id").agg(F.max("len").alias("len")), fitted, used)


def prepare_d(
    frames: Mapping[str, DataFrame],
    widths: Mapping[str, int],
    labels: DataFrame,
    config: WindowConfig = WindowConfig(),
    stats: DataFrame | None = None,
) -> Prepared:
    """Dense frames cut to the shorter modality and the cap; statistics over all of them.

    ``frames``: per modality ``subject_id, sec, features``. Subjects need both. Sequences that are
    too short count for the statistics and are dropped afterwards.
    """
    frames = {m: frames[m].select("subject_id", "sec", "features") for m in MODALITIES}
    lens = [sequence.lengths(frames[m]).withColumnRenamed("len", f"_{m}") for m in MODALITIES]
    shortest = F.least(*[f"_{m}" for m in MODALITIES], F.lit(config.max_len)).cast("long")
    # one row per subject, read by five later steps
    shared = checkpointed(
        lens[0]
        .join(lens[1], "subject_id")
        .join(labels.select("subject_id", "fold"), "subject_id")
        .select("subject_id", "fold", shortest.alias("len"))
    )
    sides = [
        join_spread(frames[m], shared, ["subject_id"], "sec")
        .where(F.col("sec") < F.col("len"))
        .select("subject_id", "sec", "fold", "len", F.col("features").alias(m))
        for m in MODALITIES
    ]
    aligned = stored(
        sides[0].join(sides[1].drop("fold", "len"), ["subject_id", "sec"]), "sequences"
    )
    fitted = (
        train_stats(aligned.where(F.col("fold") == "train"), widths, False, stats)
        if config.normalize
        else None
    )
    kept = aligned.where(F.col("len") >= config.min_len)
    lengths = shared.where(F.col("len") >= config.min_len).drop("fold")
    return Prepared(
        kept.withColumn("valid", F.lit(True)), lengths, fitted, {m: widths[m] for m in MODALITIES}
    )


def window_items(
    prepared: Prepared,
    labels: DataFrame,
    source: str,
    config: WindowConfig = WindowConfig(),
    *,
    check_validity: bool = True,
) -> DataFrame:
    """One row per window: matrices by modality, labels, fold, ``window_idx``, ``quality_score``.

    Bins are normalised before they are gathered; gaps become the normalised zero row, and zeros
    fill up short windows.
    """
    names = list(prepared.widths)
    seq, gap_rows = prepared.seq, {}
    if check_validity:
        found = windows.valid_ratio(
            seq, prepared.lengths, config.size, config.stride, config.min_valid_ratio
        )
        # numbering reads the kept windows twice
        found = windows.number_windows(checkpointed(found), config.stride)
    else:
        found = windows.window_index(prepared.lengths, config.size, config.stride).withColumn(
            "valid_ratio", F.lit(1.0)
        )
    phq = F.col("phq").cast("double") if "phq" in labels.columns else F.lit(None).cast("double")
    facts = labels.select("subject_id", "label_binary", phq.alias("label_phq"), "fold")
    # labels join the thin window index; the matrices are not moved again afterwards. Only subjects
    # with a sequence are asked for, and no index is above the length of its sequence
    longest = prepared.lengths.groupBy("subject_id").agg(F.max("len").alias("_len"))
    facts = facts.join(longest, "subject_id")
    found = join_spread(found, facts, ["subject_id"], "window_idx", last=F.col("_len")).drop("_len")
    if prepared.stats is not None:
        # one row per modality, at most two: they become literals of the plan
        wanted = prepared.stats.where(F.col("modality").isin(names))
        held = {r["modality"]: r["count"] for r in wanted.groupBy("modality").count().collect()}
        if held != {name: 1 for name in names}:
            raise ValueError(f"Statistics need one row for each of {', '.join(names)}; rows found: {held}")
        for row in wanted.collect():
            mean, std = F.lit(list(row["mean"])), F.lit(list(row["std"]))
            seq = seq.withColumn(row["modality"], standardise(F.col(row["modality"]), mean, std))
            gap_rows[row["modality"]] = F.lit([-m / s for m, s in zip(row["mean"], row["std"])])
    items = windows.to_matrix(
        found,
        seq,
        prepared.lengths,
        config.size,
        config.stride,
        prepared.widths,
        gap_rows=gap_rows,
    )
    return items.select(
        "subject_id",
        "window_idx",
        "start",
        "win_len",
        F.col("valid_ratio").alias("quality_score"),
        *names,
        "label_binary",
        "label_phq",
        "fold",
        F.lit(source).alias("dataset_source"),
    )


def pooled_windows(items: DataFrame, widths: Mapping[str, int]) -> DataFrame:
    """Window items with one ``features`` vector; two modalities of equal width are fused, of
    different widths concatenated."""
    pools = [model.window_features(F.col(n), w).alias(n) for n, w in widths.items()]
    if len(pools) == 1:
        features = pools[0]
    else:
        combine = model.fuse if len(set(widths.values())) == 1 else F.concat
        # the pooled vectors are bound once; fusing refers to each of them several times
        features = F.flatten(
            F.transform(
                F.array(F.struct(*pools)), lambda pool: combine(*[pool[n] for n in widths])
            )
        )
    return items.withColumn("features", features).drop(*widths)
