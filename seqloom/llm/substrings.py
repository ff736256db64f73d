"""Substring dedup by seed and extend, on winnowed anchors and without pairs.

A window is ``WINDOW`` consecutive words. Winnowing picks in each window the least of its ``SEED_WORDS``-word
hashes, so equal windows share their anchor wherever they stand. Neighbouring windows with one anchor
form a run, the anchor extended both ways as far as its windows go.

1. Anchors are joined on their hash, as counts: an anchor seen once has no repeated window. If it is seen
   again and the extensions of all its places are equal, all its windows repeat.
2. Only where extensions differ, mostly at the ends of shared passages, its single windows are
   counted by hash.

Windows that repeat are thus known from counts, whatever the number of copies; neighbouring ones make
up the maximal repeats, whose words are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import slices
from seqloom.session import stored

WINDOW = 35
SEED_WORDS = 8

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_arrays(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            _powers[i] = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, base, np.uint64)])
    return _powers[0][: n + 1], _powers[1][: n + 1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class Runs:
    """The words of some texts, and the runs of windows with one anchor in them."""

    def __init__(self, texts: list[bytes]):
        self.words: list[bytes] = []
        ends = []
        for text in texts:
            self.words.extend(text.split())
            ends.append(len(self.words))
        self.doc_end = np.array(ends, np.int64)
        self.doc_start = np.r_[0, self.doc_end[:-1]]
        n = len(self.words)
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(w) for w in self.words), np.uint64, n)
        powers, self._inverse = _power_arrays(n)
        self._sums = np.r_[np.uint64(0), np.cumsum(hashes * powers[:n])]
        empty = np.zeros(0, np.int64)
        self.first = self.last = self.seed_at = self.doc = empty
        self.anchor = self.extension = np.zeros(0, np.uint64)
        if n < WINDOW:
            return
        at = np.arange(n - SEED_WORDS + 1)
        seeds = _mixed(self.hash_of(at, SEED_WORDS))
        # Leftmost position of the least seed among WINDOW - SEED_WORDS + 1, by doubling.
        width, span = 1, WINDOW - SEED_WORDS + 1
        while width < span:
            step = min(width, span - width)
            left, right = at[:-step], at[step:]
            at = np.where(seeds[left] <= seeds[right], left, right)
            width += step
        starts = np.arange(n - WINDOW + 1)
        doc = np.searchsorted(self.doc_end, starts, side="right")
        whole = starts + WINDOW <= self.doc_end[doc]
        starts, at, doc = starts[whole], at[whole], doc[whole]
        if not len(starts):
            return
        border = np.flatnonzero((np.diff(at) != 0) | (np.diff(doc) != 0) | (np.diff(starts) != 1))
        first, last = np.r_[0, border + 1], np.r_[border, len(starts) - 1]
        self.first, self.last = starts[first], starts[last]
        self.seed_at, self.doc = at[first], doc[first]
        self.anchor = seeds[self.seed_at]
        shape = (self.seed_at - self.first) * 64 + (self.last - self.first)
        self.extension = _mixed(
            self.hash_of(self.first, self.last + WINDOW - self.first) + shape.astype(np.uint64) * _MIX
        )

    def hash_of(self, start: np.ndarray, size) -> np.ndarray:
        """Hash of ``size`` words from each start on."""
        return (self._sums[start + size] - self._sums[start]) * self._inverse[start]


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for texts in slices(batch.column("text")):
            runs = Runs(texts)
            rows = pa.array(runs.doc + done)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(rows),
                    batch.column("version").take(rows),
                    pa.array(runs.anchor.view(np.int64)),
                    pa.array(runs.extension.view(np.int64)),
                ],
                names=["id", "version", "anchor", "extension"],
            )
            done += len(texts)


def _digest(words: list[bytes], covered: np.ndarray) -> tuple[int, str]:
    kept = words if not covered.any() else [w for w, gone in zip(words, covered.tolist()) if not gone]
    return int(covered.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()


_FIRST_PASS = (
    "id bigint, version int, n_words bigint, n_removed bigint, kept_sha256 string, text string, "
    "covered binary, anchors array<bigint>, windows array<bigint>, starts array<int>"
)


def _cover_sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cover the runs that repeat as a whole; name the windows of the others; finish texts without any."""
    for batch in batches:
        done = 0
        for texts in slices(batch.column("text")):
            n = len(texts)
            part = batch.slice(done, n)
            done += n
            runs = Runs(texts)
            sure, mixed = part.column("sure").to_pylist(), part.column("mixed").to_pylist()
            by_doc = np.searchsorted(runs.doc, np.arange(n + 1))
            signed_anchor = runs.anchor.view(np.int64)
            out: list[tuple] = []
            for i in range(n):
                low, high = int(runs.doc_start[i]), int(runs.doc_end[i])
                words = runs.words[low:high]
                a, b = by_doc[i], by_doc[i + 1]
                edges = np.zeros(len(words) + 1, np.int32)
                anchors = windows = starts = None
                if sure[i]:
                    hit = a + np.flatnonzero(np.isin(signed_anchor[a:b], sure[i]))
                    np.add.at(edges, runs.first[hit] - low, 1)
                    np.add.at(edges, runs.last[hit] + WINDOW - low, -1)
                covered = np.cumsum(edges)[:-1] > 0
                if mixed[i]:
                    hit = a + np.flatnonzero(np.isin(signed_anchor[a:b], mixed[i]))
                    sizes = runs.last[hit] - runs.first[hit] + 1
                    at = np.repeat(runs.first[hit] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
                    anchors = np.repeat(signed_anchor[hit], sizes)
                    windows = _mixed(runs.hash_of(at, WINDOW)).view(np.int64)
                    starts = (at - low).astype(np.int32)
                    out.append((len(words), None, None, texts[i], np.packbits(covered).tobytes(), anchors, windows, starts))
                else:
                    removed, sha = _digest(words, covered)
                    out.append((len(words), removed, sha, None, None, None, None, None))
            columns = list(zip(*out))
            types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            arrays[3] = arrays[3].cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("version"), *arrays],
                names=[c.split()[0] for c in _FIRST_PASS.split(", ")],
            )


def _cover_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, shas = [], []
        for text, covered, repeated in zip(*(batch.column(c) for c in ("text", "covered", "repeated"))):
            words = text.as_py().encode().split()
            gone = np.unpackbits(np.frombuffer(covered.as_py(), np.uint8), count=len(words)).astype(bool)
            starts = np.array(repeated.as_py() or [], np.int64)
            edges = np.zeros(len(words) + 1, np.int32)
            np.add.at(edges, starts, 1)
            np.add.at(edges, starts + WINDOW, -1)
            n, sha = _digest(words, gone | (np.cumsum(edges)[:-1] > 0))
            removed.append(n)
            shas.append(sha)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(shas, pa.string())],
            names=["id", "n_words", "n_removed", "kept_sha256"],
        )


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["id"]) & (left["version"] == right["version"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ``n_words``, ``n_removed``, ``kept_sha256``.

    Removes each word covered by a window of 35 words whose word sequence also starts anywhere else in the
    table, the same text included; windows are judged on the input. Words are unchanged runs of other
    than white space, the kept ones are joined by one space. Rows that repeat (also with their id) are
    places of their own, so a repeated row of 35 words or more loses all its words. Ids are integers
    and may be null. Texts that are null, empty or of fewer than 35 words lose nothing.

    Anchors are compared with their extension and windows with their anchor, so 128 bits of hash must agree.
    Texts are shuffled once, those with undecided windows a second time.
    """
    rows = docs.select(
        docs[f"`{id_col}`"].cast("long").alias("id"),
        F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")).alias("text"),
    ).select("id", F.hash("text").alias("version"), "text")
    places = stored(
        rows.mapInArrow(_find_anchors, "id bigint, version int, anchor bigint, extension bigint"), "anchors"
    )
    # Counts are stored before they are joined, so that adaptive execution can split a hot key in the join.
    seen = stored(
        places.groupBy("anchor")
        .agg(F.count("*").alias("n"), F.min("extension").alias("low"), F.max("extension").alias("high"))
        .filter("n > 1")
        .select("anchor", (F.col("low") != F.col("high")).alias("differ")),
        "repeated-anchors",
    )
    found = (
        places.select("id", "version", "anchor")
        .join(seen, "anchor")
        .groupBy("id", "version")
        .agg(
            F.collect_set(F.when(~F.col("differ"), F.col("anchor"))).alias("sure"),
            F.collect_set(F.when(F.col("differ"), F.col("anchor"))).alias("mixed"),
        )
    )
    first = stored(
        rows.join(found, _same(rows, found), "left")
        .select(rows["id"], rows["version"], "text", "sure", "mixed")
        .mapInArrow(_cover_sure, _FIRST_PASS),
        "first-pass",
    )
    windows = first.select(
        "id", "version", F.inline(F.arrays_zip("anchors", "windows", "starts"))
    )
    repeated = stored(
        windows.groupBy("anchors", "windows").count().filter("count > 1").select("anchors", "windows"),
        "repeated-windows",
    )
    again = (
        windows.join(repeated, ["anchors", "windows"])
        .groupBy("id", "version")
        .agg(F.collect_set("starts").alias("repeated"))
    )
    open_rows = first.filter("text IS NOT NULL").select("id", "version", "n_words", "text", "covered")
    finished = (
        open_rows.join(again, _same(open_rows, again), "left")
        .select(open_rows["id"], "n_words", "text", "covered", "repeated")
        .mapInArrow(_cover_rest, "id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    )
    closed = first.filter("text IS NULL").select("id", "n_words", "n_removed", "kept_sha256")
    return closed.unionByName(finished).withColumnRenamed("id", id_col)
