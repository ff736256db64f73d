"""Learned decision lists for document quality, in DataFrame operations only.

Sequential covering grows threshold conjunctions that cover labelled junk, prunes each on rows it
was not grown on, and takes the covered rows away. The list is applied as one ordered chain of
Spark conditions, so scoring is a projection without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import SPACE, words
from seqloom.session import stored

#: Labelled rows that a list is learned from, at most on average (a hash decides which).
SAMPLE_ROWS = 20_000
#: Cut points tried for each measure.
CUTS = 32
MAX_CONDITIONS = 3
MAX_RULES = 12
#: Share of junk among the rows a pruned rule covers, on rows it was not grown on.
MIN_PRECISION = 0.95
#: Junk rows that a rule must cover to be tried.
MIN_COVERED = 8

MEASURES = (
    "n_words",
    "mean_word_chars",
    "symbols_per_word",
    "dup_line_share",
    "repeat_word_share",
    "distinct_word_share",
    "capital_share",
)


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.measure) > self.cut if self.above else F.col(self.measure) <= self.cut

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction; a document that meets all its conditions is junk."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = self.conditions[0].column()
        for condition in self.conditions[1:]:
            out = out & condition.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc`` (a struct of all columns of ``docs``) with the counts and measures of each text.

    Words are runs of other than white space (U+0020, U+0009 to U+000D). A null text counts as an
    empty one: no words, no lines with a word, all measures 0. Eight-word windows are compared within
    their text by a 64-bit hash. Columns of ``docs`` stay inside the struct, so no name can clash.
    Texts without a repeated window, nearly all, are settled by one distinct count; only the others
    are sorted. All of it is one narrow projection: no shuffle, rows are never split.
    """
    base = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"),
        F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")).alias("text"),
    )
    split = base.select(
        "doc",
        "text",
        words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"),
    )
    hashed = split.select("*", F.transform("words", lambda x: F.xxhash64(x)).alias("h1"))
    # Windows of 2, 4 and 8 words, each a hash of two windows of half the size. Only the first
    # n - 7 entries of the last are windows; the others lack words at the end.
    for size in (1, 2, 4):
        half = f"h{size}"
        hashed = hashed.withColumn(
            f"h{2 * size}",
            F.zip_with(half, F.slice(half, size + 1, F.size(half)), lambda a, b: F.xxhash64(a, b)),
        )
    counted = hashed.select(
        "doc",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("h1")).cast("long").alias("n_distinct"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.slice("h8", F.lit(1), F.greatest(F.lit(0), F.size("words") - 7)).alias("windows"),
    )
    plain = [c for c in counted.columns if c != "windows"]
    ordered = counted.select(
        *plain,
        F.when(
            F.size("windows") > F.size(F.array_distinct("windows")),
            F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("ordered"),
    )
    repeated = ordered.select(
        *plain,
        F.array_sort(
            F.transform(
                F.filter(
                    "ordered",
                    lambda x, j: (x["h"] == F.get("ordered", j - 1)["h"])
                    | (x["h"] == F.get("ordered", j + 1)["h"]),
                ),
                lambda x: x["i"],
            )
        ).alias("starts"),
    )
    covered = F.aggregate(
        F.transform(
            "starts", lambda p, j: F.least(F.lit(8), F.coalesce(F.get("starts", j + 1) - p, F.lit(8)))
        ),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    with_repeats = repeated.select(*plain, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    return with_repeats.select(
        "*",
        share("word_chars", "n_words").alias("mean_word_chars"),
        share("n_symbols", "n_words").alias("symbols_per_word"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_word_share"),
        share("n_distinct", "n_words").alias("distinct_word_share"),
        share("n_capitals", "word_chars").alias("capital_share"),
        (
            (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
        ).alias("base_failed"),
    )


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> list[Rule]:
    """An ordered list of junk rules from documents labelled 1 (good) or 0 (junk).

    At most about ``sample_rows`` labelled documents, chosen by a hash of their id, are measured; the
    driver gets only their counts by cell of the cut grid. Labels that are null or other than 0 and 1
    are no labels; an id labelled both ways, or a null id, teaches nothing. Without labels of both
    kinds the list is empty: every document then keeps the default verdict. Documents of under 20
    words, which the fixed base rule refuses, are not learned from.
    """
    spark = docs.sparkSession
    known = (
        labels.select(labels[f"`{id_col}`"].alias("key"), labels[f"`{label_col}`"].alias("label"))
        .filter("key IS NOT NULL AND label IN (0, 1)")
        .groupBy("key")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .filter("label = other")
    )
    total = known.count()
    if total == 0:
        return []
    share = min(1.0, sample_rows / total)
    steps = 1 << 20
    picked = known.filter(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(steps)) < int(share * steps)).select(
        "key", "label"
    )
    # About sample_rows rows of two longs at most, so the size of the broadcast is bounded.
    chosen = docs.select(docs[f"`{id_col}`"].alias("key"), docs[f"`{text_col}`"].alias("text")).join(
        F.broadcast(picked), "key"
    )
    # Stored before it is filtered: a filter pushed below would measure every text twice.
    measured = stored(
        with_statistics(chosen).select(
            F.col("doc.key").alias("key"),
            F.col("doc.label").alias("label"),
            *[F.col(m).cast("double").alias(m) for m in MEASURES],
        ),
        "quality-sample",
    ).filter("n_words >= 20")
    quantiles = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    # Junk may be rare, so each label gives cut points of its own.
    cuts_rows = (
        measured.groupBy("label")
        .agg(*[F.percentile_approx(m, quantiles, 1000).alias(m) for m in MEASURES])
        .collect()
    )
    if len(cuts_rows) < 2:
        return []
    cuts = {m: sorted({c for row in cuts_rows for c in row[m]}) for m in MEASURES}
    binned = measured.select(
        (F.col("label") == 0).alias("junk"),
        (F.pmod(F.xxhash64("key", F.lit(11)), F.lit(3)) == 0).alias("held"),
        *[_bin(m, cuts[m]) for m in MEASURES],
    )
    cells = [
        (row["junk"], row["held"], [row[m] for m in MEASURES], row["count"])
        for row in binned.groupBy("junk", "held", *MEASURES).count().collect()
    ]
    return _cover(cells, cuts)


def _bin(measure: str, cuts: list[float]) -> Column:
    """How many of the cut points lie below the measure."""
    below = F.filter(F.array(*[F.lit(c) for c in cuts]), lambda cut: cut < F.col(measure))
    return F.size(below).alias(measure)


def _cover(cells: list[tuple[bool, bool, list[int], int]], cuts: dict[str, list[float]]) -> list[Rule]:
    """Sequential covering over counted cells: (junk, held out for pruning, bins, count)."""
    rules: list[Rule] = []
    left = cells
    while len(rules) < MAX_RULES:
        grown = _grow([c for c in left if not c[1]], cuts)
        kept = _prune(grown, [c for c in left if c[1]])
        if not kept:
            break
        rules.append(
            Rule(tuple(Condition(MEASURES[m], above, cuts[MEASURES[m]][cut]) for m, above, cut in kept))
        )
        left = [c for c in left if not _meets(c[2], kept)]
    return rules


def _meets(bins: list[int], conditions) -> bool:
    # Bin b holds the values with exactly b cut points below them: value > cuts[k] iff b > k.
    return all((bins[m] > cut) == above for m, above, cut in conditions)


def _grow(cells, cuts) -> list[tuple[int, bool, int]]:
    """Add the condition of the greatest information gain until no good document is covered."""
    conditions: list[tuple[int, bool, int]] = []
    while len(conditions) < MAX_CONDITIONS:
        junk = sum(c[3] for c in cells if c[0])
        good = sum(c[3] for c in cells if not c[0])
        if junk < MIN_COVERED or (conditions and good == 0):
            break
        before = math.log2(junk / (junk + good))
        best, best_gain = None, 1e-9
        for m, name in enumerate(MEASURES):
            width = len(cuts[name]) + 1
            by_bin = [[0, 0] for _ in range(width)]
            for is_junk, _, bins, count in cells:
                by_bin[bins[m]][not is_junk] += count
            below_junk = below_good = 0
            for cut in range(width - 1):
                below_junk += by_bin[cut][0]
                below_good += by_bin[cut][1]
                for above, p, n in ((False, below_junk, below_good), (True, junk - below_junk, good - below_good)):
                    if p >= MIN_COVERED:
                        gain = p * (math.log2(p / (p + n)) - before)
                        if gain > best_gain:
                            best, best_gain = (m, above, cut), gain
        if best is None:
            break
        conditions.append(best)
        cells = [c for c in cells if _meets(c[2], [best])]
    return conditions


def _prune(conditions, cells):
    """The prefix that separates held-out rows best; none if it is not precise enough there."""
    best, best_worth = [], -math.inf
    for n in range(1, len(conditions) + 1):
        junk = sum(c[3] for c in cells if c[0] and _meets(c[2], conditions[:n]))
        good = sum(c[3] for c in cells if not c[0] and _meets(c[2], conditions[:n]))
        if junk == 0 or junk / (junk + good) < MIN_PRECISION:
            continue
        worth = (junk - 4 * good) / (junk + good)
        if worth > best_worth:
            best, best_worth = conditions[:n], worth
    return best


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``with_statistics`` plus ``rule`` (1-based number of the first rule met, else 0) and ``kept``.

    A document is kept if the base rule does not fail and no rule is met.
    """
    measured = with_statistics(docs, text_col)
    number = F.lit(0)
    if rules:
        chain = F.when(rules[0].column(), 1)
        for i, rule in enumerate(rules[1:], start=2):
            chain = chain.when(rule.column(), i)
        number = chain.otherwise(0)
    return measured.withColumn("rule", number).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0)
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the learned list keeps, with their own columns only.

    Each document becomes a list of itself or of nothing, which is then unnested. A filter on ``kept``
    would be pushed below the projections and measure every text twice.
    """
    judged = judge(docs, learn(docs, labels, id_col, text_col), text_col)
    return judged.select(F.inline(F.when(F.col("kept"), F.array("doc"))))
