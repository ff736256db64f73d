"""Line dedup with levelled sorted runs of line hashes, in DataFrame operations only.

Documents come in batches of descending id. A batch merge-anti-joins the runs: keys the runs lack
get the batch's largest document as their holder, keys they have only add to the count. Its own keys
become a run of level 0; every ``FANOUT`` runs of a level are compacted into one of the next.
A run is a Parquet table bucketed and sorted by hash, so merging a batch shuffles the batch only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import SPACE_CHARS, ascii_lower
from seqloom.session import delete_path, new_shared_path, register, stored

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


class LineRuns:
    """Runs of (h1, h2, n_docs, holder): a 128-bit key hash, its documents so far, its holder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = register(new_shared_path(self.spark, name))
        (
            run.repartition(self.buckets, "h1", "h2")
            .write.bucketBy(self.buckets, "h1", "h2")
            .sortBy("h1", "h2")
            .option("path", self.paths[name])
            .saveAsTable(name)
        )
        return name

    def add(self, batch: DataFrame) -> None:
        """Take up a batch of (h1, h2, doc), all of it below the documents taken up before."""
        own = (
            batch.distinct()
            .groupBy("h1", "h2")
            .agg(F.count("*").alias("n_docs"), F.max("doc").alias("holder"))
        )
        seen = F.lit(False)
        for i, name in enumerate(self.tables()):  # one merge with each run; its side is not shuffled
            run = self.spark.table(name).select("h1", "h2", F.lit(True).alias(f"seen{i}"))
            own = own.join(run, ["h1", "h2"], "left")
            seen = seen | F.col(f"seen{i}").isNotNull()
        fresh_holder = F.when(~seen, F.col("holder")).alias("holder")
        self._push(0, self._write(own.select("h1", "h2", "n_docs", fresh_holder)))

    def tables(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def drop(self) -> None:
        self._remove(self.tables())
        self.levels = []

    def _remove(self, names: list[str]) -> None:
        """Dropping a table that has a path of its own leaves its files, so they are deleted by themselves."""
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            delete_path(self.spark, self.paths.pop(name))

    def _push(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._write(self._merge(merged)))
            self._remove(merged)

    def _merge(self, names: list[str]) -> DataFrame:
        """One row for each key: counts add up, and at most one run names a holder.

        Sorted runs are merged by an outer merge join, which needs no shuffle of either. (A union of
        bucketed tables is no way: Spark 4.1 may take it for partitioned by key after it has
        turned their bucketed scans off.)
        """
        out = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).select(
                "h1", "h2", F.col("n_docs").alias("more"), F.col("holder").alias("other_holder")
            )
            out = out.join(other, ["h1", "h2"], "full_outer").select(
                "h1",
                "h2",
                (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"),
                F.coalesce("holder", "other_holder").alias("holder"),
            )
        return out

    def totals(self) -> DataFrame | None:
        return self._merge(self.tables()) if self.levels else None


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
) -> DataFrame:
    """Each row of ``docs`` as a struct ``doc`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents loses all its
    lines except those in the document with the largest id that holds it. Ids are integers; rows that
    share an id are one document in the counts, and each keeps its row. A row with a null id is no
    document: its lines count nowhere and all stay. A null or empty text is one empty line. Kept lines
    are joined by ``\\n``; a text that loses all lines becomes empty.

    A very common line is one row in each run, since batches are aggregated before they are merged; it
    meets its occurrences in a join that adaptive execution can split.
    """
    spark = docs.sparkSession
    keyed = docs.select(
        docs[f"`{id_col}`"].cast("long").alias("id"),
        F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")).alias("text"),
    )
    bounds = keyed.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    lines = (
        keyed.filter("id IS NOT NULL")
        .select("id", F.hash("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("id", "version", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_chars)
    )
    low, high = bounds["low"] or 0, bounds["high"] or 0
    step = float(max(1, -(-(high - low + 1) // batches)))
    # Never rising with the id, which is all that the order of the batches needs.
    batch = F.floor((F.lit(float(high)) - F.col("id").cast("double")) / F.lit(step))
    staged = stored(
        lines.select(
            "id",
            "version",
            "pos",
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit(1), "key").alias("h2"),
            F.greatest(F.lit(0), F.least(F.lit(batches - 1), batch)).cast("int").alias("batch"),
        ),
        "lines",
        ("batch",),
    )
    runs = LineRuns(spark)
    for b in range(batches):
        runs.add(staged.filter(F.col("batch") == b).select("h1", "h2", F.col("id").alias("doc")))
    common = stored(
        runs.totals().filter(F.col("n_docs") >= min_docs).select("h1", "h2", "holder"), "common-lines"
    )
    runs.drop()
    dropped = (
        staged.join(common, ["h1", "h2"])
        .filter("id <> holder")
        .select("id", "version", "pos")
        .groupBy("id", "version")
        .agg(F.collect_set("pos").alias("dropped"))
    )
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"),
        docs[f"`{id_col}`"].cast("long").alias("id"),
        F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")).alias("text"),
    ).withColumn("version", F.hash("text"))
    joined = rows.join(dropped, ["id", "version"], "left").select(
        "doc", "text", "dropped", F.split("text", "\n").alias("lines")
    )
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    return joined.select(
        "doc",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text"))
        .otherwise(F.array_join(F.transform(left, lambda p: F.get("lines", p)), "\n"))
        .alias("kept_text"),
    )
