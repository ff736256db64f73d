"""Subject-level evaluation. Every function takes ``by`` so that seeds, methods, tracks and slices
are groups of one Spark job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.skew import ONE_TASK_ROWS, join_null_safe, ordered_prefix
from seqloom.session import checkpointed

NAN = float("nan")


def _is(label: int, prediction: int) -> Column:
    return ((F.col("label") == label) & (F.col("prediction") == prediction)).cast("long")


def confusion(subjects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts ``tn, fp, fn, tp`` with zeros kept, the number of subjects and the Brier score."""
    error = F.col("probability") - F.col("label")
    counts = subjects.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_subjects"),
        *[
            F.coalesce(F.sum(_is(label, prediction)), F.lit(0)).alias(name)
            for name, label, prediction in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
        ],
        F.avg(error * error).alias("brier_score"),
    )
    return counts


def confusion_long(subjects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The 2 x 2 matrix as one row per true class: ``true_label, pred_0, pred_1``."""
    cells = F.array(
        F.struct(F.lit(0).alias("t"), F.col("tn").alias("p0"), F.col("fp").alias("p1")),
        F.struct(F.lit(1).alias("t"), F.col("fn").alias("p0"), F.col("tp").alias("p1")),
    )
    return confusion(subjects, by).select(*by, F.explode(cells).alias("c")).select(
        *by,
        F.col("c.t").alias("true_label"),
        F.col("c.p0").alias("pred_0"),
        F.col("c.p1").alias("pred_1"),
    )


def _ratio(numerator: Column, denominator: Column, empty: float | None = 0.0) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(empty).cast("double"))


def precision() -> Column:
    return _ratio(F.col("tp"), F.col("tp") + F.col("fp"))


def recall() -> Column:
    return _ratio(F.col("tp"), F.col("tp") + F.col("fn"))


def macro_f1() -> Column:
    """Mean F1 over the classes that occur among labels or predictions."""
    errors = F.col("fp") + F.col("fn")
    sizes = (2 * F.col("tn") + errors, 2 * F.col("tp") + errors)
    scores = [_ratio(2 * hits, size) for hits, size in zip((F.col("tn"), F.col("tp")), sizes)]
    present = [(size > 0).cast("int") for size in sizes]
    return _ratio(scores[0] + scores[1], present[0] + present[1], None)


def weighted_f1() -> Column:
    """F1 weighted by the number of subjects in each true class."""
    errors = F.col("fp") + F.col("fn")
    f1_negative = _ratio(2 * F.col("tn"), 2 * F.col("tn") + errors)
    f1_positive = _ratio(2 * F.col("tp"), 2 * F.col("tp") + errors)
    negatives, positives = F.col("tn") + F.col("fp"), F.col("tp") + F.col("fn")
    return _ratio(f1_negative * negatives + f1_positive * positives, negatives + positives, None)


def with_scores(counts: DataFrame) -> DataFrame:
    """Add the F1 family to a table of confusion counts."""
    return counts.withColumns(
        {
            "precision": precision(),
            "recall": recall(),
            "macro_f1": macro_f1(),
            "weighted_f1": weighted_f1(),
        }
    )


def bin_edges(bins: int) -> list[float]:
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def bin_index(p: Column, bins: int = 10) -> Column:
    """Equal bins closed on the left, the last closed on both sides; NULL outside [0, 1].

    The edges are compared as doubles, because multiplying ``p`` by the number of bins would move
    values that lie on an edge.
    """
    passed = reduce(
        lambda a, b: a + b, [(p >= F.lit(edge)).cast("int") for edge in bin_edges(bins)[:-1]]
    )
    return F.when((p >= F.lit(0.0)) & (p <= F.lit(1.0)), passed - 1)


def _binned(subjects: DataFrame, bins: int, by: Sequence[str]) -> DataFrame:
    return (
        subjects.withColumn("bin_index", bin_index(F.col("probability"), bins))
        .groupBy(*by, "bin_index")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg("probability").alias("mean_confidence"),
            F.avg("label").alias("mean_accuracy"),
        )
    )


def expected_calibration_error(
    subjects: DataFrame, bins: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    gap = F.abs(F.col("mean_accuracy") - F.col("mean_confidence")) * F.col("count")
    inside = F.col("bin_index").isNotNull()
    return (
        _binned(subjects, bins, by)
        .groupBy(*by)
        .agg(
            (F.coalesce(F.sum(F.when(inside, gap)), F.lit(0.0)) / F.sum("count")).alias("ece")
        )
    )


def _binned_counts(counts: DataFrame, bins: int, by: Sequence[str]) -> DataFrame:
    n = F.col("_n")
    return (
        counts.withColumn("bin_index", bin_index(F.col("probability"), bins))
        .groupBy(*by, "bin_index")
        .agg(
            F.sum(n).alias("count"),
            (F.sum(n * F.col("probability")) / F.sum(n)).alias("mean_confidence"),
            (F.sum(n * F.col("label")) / F.sum(n)).alias("mean_accuracy"),
        )
    )


def calibration_bins(subjects: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """One row per bin, empty bins kept with count 0 and NULL means."""
    return _spine(_binned(subjects, bins, by), bins, by)


def _spine(filled: DataFrame, bins: int, by: Sequence[str]) -> DataFrame:
    """Binned rows of each group with the empty bins added."""
    edges = bin_edges(bins)
    spine = F.array(
        *[
            F.struct(
                F.lit(i).alias("bin_index"),
                F.lit(edges[i]).alias("left"),
                F.lit(edges[i + 1]).alias("right"),
            )
            for i in range(bins)
        ]
    )
    found = F.map_from_entries(
        F.collect_list(
            F.when(
                F.col("bin_index").isNotNull(),
                F.struct(
                    F.col("bin_index"),
                    F.struct("count", "mean_confidence", "mean_accuracy"),
                ),
            )
        )
    )
    # at most bins + 1 rows per group are collected here
    grouped = filled.groupBy(*by).agg(found.alias("_found"))
    cell = F.try_element_at(F.col("_found"), F.col("_bin.bin_index"))
    return grouped.withColumn("_bin", F.explode(spine)).select(
        *by,
        F.col("_bin.bin_index").alias("bin_index"),
        F.col("_bin.left").alias("left"),
        F.col("_bin.right").alias("right"),
        F.coalesce(cell["count"], F.lit(0)).alias("count"),
        cell["mean_confidence"].alias("mean_confidence"),
        cell["mean_accuracy"].alias("mean_accuracy"),
    )


def threshold_points(subjects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct probability."""
    return subjects.groupBy(*by, "probability").agg(
        F.sum(F.col("label").cast("long")).alias("pos"),
        F.sum((1 - F.col("label")).cast("long")).alias("neg"),
    )


def _ranked(points: DataFrame, by: Sequence[str], lead: Sequence[str] = ()) -> DataFrame:
    """Points with the positives and negatives above each, by falling probability."""
    falling = -F.col("probability")
    return ordered_prefix(points, by, falling, ["pos", "neg"], lead, ONE_TASK_ROWS)


def ranking_scores(subjects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``auroc`` with ties counted half and ``pr_auc`` (step-wise average precision).

    Both are NaN where only one class occurs.
    """
    return _ranking(threshold_points(subjects, by), by)


def _ranking(points: DataFrame, by: Sequence[str]) -> DataFrame:
    ranked = _ranked(points, by)
    tp = F.col("before_pos") + F.col("pos")
    area = F.col("neg") * (F.col("before_pos") + F.col("pos") / F.lit(2.0))
    step = F.col("pos") * (tp / (tp + F.col("before_neg") + F.col("neg")))
    sums = ranked.groupBy(*by).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(area).alias("_area"),
        F.sum(step).alias("_steps"),
    )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    pairs = F.col("positives").cast("double") * F.col("negatives").cast("double")
    return sums.select(
        *by,
        F.when(both, F.col("_area") / pairs).otherwise(F.lit(NAN)).alias("auroc"),
        F.when(both, F.col("_steps") / F.col("positives")).otherwise(F.lit(NAN)).alias("pr_auc"),
    )


def _curve_base(
    subjects: DataFrame, by: Sequence[str], lead: Sequence[str] = ()
) -> DataFrame:
    """Cumulative counts per threshold, for groups in which both classes occur."""
    ranked = _ranked(threshold_points(subjects, by), by, lead)
    return ranked.where("total_pos > 0 and total_neg > 0")


def _with_end_point(curve: DataFrame, by: Sequence[str], is_edge: Column, edge: Column) -> DataFrame:
    """Emit ``edge`` as an additional row next to the single row marked by ``is_edge``."""
    row = F.struct(*[c for c in curve.columns if not c.startswith("_") and c not in by])
    both = F.when(is_edge, F.array(row, edge)).otherwise(F.array(row))
    return curve.select(*by, F.explode(both).alias("_row")).select(*by, "_row.*")


def roc_curve(
    subjects: DataFrame, by: Sequence[str] = (), drop_intermediate: bool = True
) -> DataFrame:
    """``threshold, fpr, tpr`` by falling threshold, starting at (0, 0) with an infinite threshold.

    ``drop_intermediate`` leaves out thresholds that lie on a straight line between neighbours.
    """
    base = _curve_base(subjects, by, ["pos", "neg"] if drop_intermediate else [])
    if drop_intermediate:
        first = (F.col("before_pos") + F.col("before_neg")) == 0
        last = F.col("next_pos").isNull()
        bends = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        base = base.where(first | last | bends)
    curve = base.select(
        *by,
        F.col("probability").alias("threshold"),
        ((F.col("before_neg") + F.col("neg")) / F.col("total_neg")).alias("fpr"),
        ((F.col("before_pos") + F.col("pos")) / F.col("total_pos")).alias("tpr"),
        ((F.col("before_pos") + F.col("before_neg")) == 0).alias("_edge"),
    )
    start = F.struct(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return _with_end_point(curve, by, F.col("_edge"), start)


def pr_curve(subjects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``threshold, precision, recall``, ended by (precision 1, recall 0) without a threshold."""
    base = _curve_base(subjects, by)
    tp = F.col("before_pos") + F.col("pos")
    curve = base.select(
        *by,
        F.col("probability").alias("threshold"),
        (tp / (tp + F.col("before_neg") + F.col("neg"))).alias("precision"),
        (tp / F.col("total_pos")).alias("recall"),
        ((F.col("before_pos") + F.col("before_neg")) == 0).alias("_edge"),
    )
    end = F.struct(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return _with_end_point(curve, by, F.col("_edge"), end)


def probability_counts(subjects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Subjects by (probability, label, prediction): all that the metrics need, combined before the shuffle."""
    return subjects.groupBy(*by, "probability", "label", "prediction").agg(
        F.count(F.lit(1)).alias("_n")
    )


def metrics_from_counts(counts: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """The full metrics record from the counts above, which are read twice: store them."""
    n, p, y = F.col("_n"), F.col("probability"), F.col("label")
    binned = (
        counts.withColumn("_bin", bin_index(p, bins))
        .groupBy(*by, "_bin")
        .agg(
            F.sum(n).alias("num_subjects"),
            *[
                F.sum(_is(label, prediction) * n).alias(name)
                for name, label, prediction in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
            ],
            F.sum(n * (p - y) * (p - y)).alias("_square"),
            F.sum(F.when((p - y).isNotNull(), n)).alias("_known"),
            F.abs(F.sum(n * y) - F.sum(n * p)).alias("_gap"),
        )
    )
    gap = F.coalesce(F.sum(F.when(F.col("_bin").isNotNull(), F.col("_gap"))), F.lit(0.0))
    base = with_scores(
        binned.groupBy(*by).agg(
            F.coalesce(F.sum("num_subjects"), F.lit(0)).alias("num_subjects"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tn", "fp", "fn", "tp")],
            (F.sum("_square") / F.sum("_known")).alias("brier_score"),
            (gap / F.sum("num_subjects")).alias("ece"),
        )
    )
    points = counts.groupBy(*by, "probability").agg(
        F.sum(n * y.cast("long")).alias("pos"), F.sum(n * (1 - y).cast("long")).alias("neg")
    )
    ranking = _ranking(points, by)
    if by:
        joined = join_null_safe(base, ranking, by)
    else:
        joined = base.withColumn("_all", F.lit(0)).join(ranking.withColumn("_all", F.lit(0)), "_all")
    record = [c for c in base.columns if c not in (*by, "ece")]
    return joined.select(*by, *record, "ece", "auroc", "pr_auc")


def classification_metrics(
    subjects: DataFrame, by: Sequence[str] = (), bins: int = 10
) -> DataFrame:
    """The full metrics record, one row per group; a NULL key is a group of its own.

    The subjects are read once; everything comes from their stored counts.
    """
    return metrics_from_counts(checkpointed(probability_counts(subjects, by)), by, bins)


def slice_metrics(subjects: DataFrame, slices: Mapping[str, Column], bins: int = 10) -> DataFrame:
    """The full metrics record for every value of every slice: ``slice, value`` and the record.

    All slices are counted in one pass over the subjects. A NULL value is a slice of its own.
    """
    entries = F.array(
        *[F.struct(F.lit(n).alias("slice"), c.cast("string").alias("value")) for n, c in slices.items()]
    )
    rows = subjects.select("probability", "label", "prediction", F.explode(entries).alias("_s")).select(
        "probability", "label", "prediction", "_s.slice", "_s.value"
    )
    return classification_metrics(rows, ["slice", "value"], bins)


def calibration_record(subjects: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Calibration in one row per group: number of subjects, ECE, Brier score and the bins as an array."""
    counts = checkpointed(probability_counts(subjects, by))
    weighted = counts.select(
        *by, "probability", "label", "_n", F.lit(None).cast("int").alias("prediction")
    )
    totals = metrics_from_counts(weighted, by, bins).select(*by, "num_subjects", "ece", "brier_score")
    filled = _spine(_binned_counts(weighted, bins, by), bins, by)
    cells = filled.groupBy(*by).agg(
        F.array_sort(
            F.collect_list(F.struct("bin_index", "left", "right", "count", "mean_confidence", "mean_accuracy"))
        ).alias("bins")
    )
    if by:
        return join_null_safe(totals, cells, by)
    key = "_all"
    return totals.withColumn(key, F.lit(0)).join(cells.withColumn(key, F.lit(0)), key).drop(key)
