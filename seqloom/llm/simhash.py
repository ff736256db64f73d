"""SimHash near-dedup by anchor points of a covering code.

The anchors are the words of the perfect Hamming code on 63 of the 64 bits: every bit string lies within
one bit of exactly one anchor (covering radius 1). Two fingerprints that differ in at most two bits have
a point between them within one bit of each, and the anchor within one bit of that point lies within
two bits of both. So each fingerprint is replicated to all anchors within two bits of it (the radius
plus half of the threshold on each side; 32 of them, or one if it is an anchor itself), and
fingerprints are compared within their anchors only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from seqloom.llm.common import free_name, signed, slices
from seqloom.llm.components import components
from seqloom.session import stored

SHINGLE = 3
SEED = 42
MAX_BITS = 2


def _fingerprints(texts: list[bytes]) -> np.ndarray:
    hashes: list[int] = []
    ends = []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = text.lower().split()  # bytes: A-Z alone change, and white space is that of the contract
        if len(words) >= SHINGLE:
            hashes.extend(
                [digest(a + b" " + b + b" " + c, SEED) for a, b, c in zip(words, words[1:], words[2:])]
            )
        elif words:
            hashes.append(digest(b" ".join(words), SEED))
        ends.append(len(hashes))
    values = np.array(hashes, np.uint64)
    out = np.zeros(len(texts), np.uint64)
    start = 0
    for i, end in enumerate(ends):
        n, ones = end - start, np.zeros(64, np.int64)
        for low in range(start, end, 100_000):
            part = values[low : min(end, low + 100_000)].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        if n:
            out[i] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
        start = end
    return out


@F.arrow_udf(LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    """The 64-bit SimHash of each text's 3-word shingles as a signed long; 0 for a text without words.

    A-Z are lower-cased, repeats count, a text of fewer words is one shingle. A bit is set if it is set
    in over half of the XXH64 hashes (seed 42). Null: an empty text.
    """
    parts = [_fingerprints(part) for part in slices(texts)]
    return signed(np.concatenate(parts) if parts else np.zeros(0, np.uint64))


def _syndrome(fp: Column) -> Column:
    """Number of the bit (1 to 63) whose flip leads to the nearest anchor; 0 if this is one."""
    out = F.lit(0)
    for j in range(6):
        mask = sum(1 << p for p in range(1, 64) if p >> j & 1)
        signed_mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        parity = F.bit_count(fp.bitwiseAND(F.lit(signed_mask))).bitwiseAND(F.lit(1))
        out = out + parity * F.lit(1 << j)
    return out


def anchors(fp: Column) -> Column:
    """All anchors within two bits of a fingerprint, bit 0 left out (set to 0 in every anchor)."""
    core = fp.bitwiseAND(F.lit(-2))
    s = _syndrome(core)

    def flip(value: Column, bit: Column) -> Column:
        return value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))

    # Flipping p and p XOR s changes the syndrome by s, which makes it 0.
    pairs = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(63)), lambda p: p < p.bitwiseXOR(s)),
        lambda p: flip(flip(core, p), p.bitwiseXOR(s)),
    )
    nearest = F.array(flip(core, s))
    return F.when(s == 0, F.array(core)).otherwise(F.concat(nearest, pairs))


def _links_of_run(values: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links within one anchor's fingerprints.

    At most 4034 distinct fingerprints can lie within two bits of an anchor on 63 bits, so the
    comparison is bounded whatever the data are. Links that join what is joined already are left out.
    """
    root = list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    found = []
    for i in range(len(values) - 1):
        near = np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= MAX_BITS)
        for j in (near + i + 1).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                found.append((i, j))
    return found


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each anchor of rows (anchor, fp) that come sorted; a run may cross batches."""
    held_anchor, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, int)
        sizes = np.diff(np.r_[starts, len(anchor)])
        a, b = [], []
        pairs = starts[sizes == 2]
        near = pairs[np.bitwise_count((fp[pairs] ^ fp[pairs + 1]).view(np.uint64)) <= MAX_BITS]
        a.append(fp[near])
        b.append(fp[near + 1])
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
            values = fp[start : start + size]
            found = np.array(_links_of_run(values.view(np.uint64)), int).reshape(-1, 2)
            a.append(values[found[:, 0]])
            b.append(values[found[:, 1]])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"]
        )

    for batch in batches:
        anchor = np.concatenate([held_anchor, batch.column(0).to_numpy()])
        fp = np.concatenate([held_fp, batch.column(1).to_numpy()])
        if len(anchor):
            # The last anchor may go on in the next batch.
            whole = int(np.searchsorted(anchor, anchor[-1]))
            held_anchor, held_fp = anchor[whole:], fp[whole:]
            yield links(anchor[:whole], fp[:whole])
    yield links(held_anchor, held_fp)


def link_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct values of ``fp`` that differ in at most two bits."""
    replicas = fingerprints.select("fp", F.explode(anchors(F.col("fp"))).alias("anchor"))
    parts = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        replicas.select("anchor", "fp")
        .repartition(parts, "anchor")
        .sortWithinPartitions("anchor", "fp")
        .mapInArrow(_compare, "a bigint, b bigint")
        .distinct()
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ``fp`` and ``component_id``.

    ``component_id`` is the smallest id that links reach, the row's own included; links join
    fingerprints that differ in at most two bits, and so all texts without words. Rows with equal
    fingerprints (exact copies among them) are one point from the start, and only distinct points are
    replicated, compared and linked. Ids may repeat or be null; a component of null ids only has a null
    ``component_id``. The join back by fingerprint is one that adaptive execution can split.
    """
    rows = stored(
        docs.select(docs[f"`{id_col}`"].alias("id"), fingerprint(docs[f"`{text_col}`"].cast("string")).alias("fp")),
        "fingerprints",
    )
    points = stored(rows.groupBy("fp").agg(F.min("id").alias("first")), "points")
    joined = components(link_fingerprints(points.select("fp")))
    grouped = points.join(joined, points["fp"] == joined["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("group")
    )
    least = grouped.groupBy("group").agg(F.min("first").alias("component_id"))
    named = grouped.join(least, "group").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each component, with all its columns.

    Rows that repeat an id are one document, of which one row stays. Rows without an id stay, as nothing
    names them.
    """
    return kept_rows(docs, near_duplicates(docs, id_col, text_col), id_col)


def kept_rows(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is the ``component_id`` that ``found`` gives it, one for each id."""
    key, row = free_name(docs, "_keep"), free_name(docs, "_row")
    kept = found.filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(key)).distinct()
    named = docs.filter(docs[f"`{id_col}`"].isNotNull())
    first = (
        named.join(kept, named[f"`{id_col}`"] == F.col(key))
        .groupBy(key)
        .agg(F.first(F.struct(*[named[f"`{c}`"] for c in docs.columns])).alias(row))
        .select(f"{row}.*")
    )
    return first.unionByName(docs.filter(docs[f"`{id_col}`"].isNull()))
