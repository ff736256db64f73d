"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

Spark builds the index of the items and stores it. It is broadcast block by block, each of a bounded number
of items and words, and each passage of every document is a query against it: overlapping passages twice
as long as the longest item of about that length, so that any place an item could stand lies whole in one
of them. Scores are BM25 impacts over the item's own score, which makes one threshold do for all items.
All items at or above it are retrieved and then verified by their word shingles: question and
answer each, or the whole item with some of the words of both. Where there are several blocks, each is one
pass whose outcome is written, and its broadcast is given up before the next.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from seqloom.llm.common import ascii_lower, slices, words
from seqloom.session import release, stored

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach to retrieve it.
MIN_SCORE = 0.6
#: Words of a shingle, and the share of an item's shingles that must be found.
SHINGLE = 5
MIN_OVERLAP = 0.8
#: Share of the distinct words of question and answer each that must be there if the whole item decides.
MIN_PART = 0.6
#: Items of fewer words match as an exact run of words only.
MIN_WORDS = 5
#: Items in a block of the index, and words in all of them; bounds what is broadcast at once.
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 2_000_000
#: Items of up to so many words share passages of one length; longer ones go by factors of four.
SHORT = 64
#: Postings that share one maximum.
POSTINGS_BLOCK = 64

#: ASCII signs, which part words like white space does.
SIGNS = "\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E"
_BLANKED = bytes(32 if chr(b) in string.punctuation else b for b in range(128)) + bytes(range(128, 256))

_HIT = StructType(
    [
        StructField("item_id", LongType()),
        StructField("score", DoubleType()),
        StructField("question_overlap", DoubleType()),
        StructField("answer_overlap", DoubleType()),
    ]
)


def item_index(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per item: ``item``, ``text``, ``words`` and ``impacts``, each distinct word with its share of the
    item's BM25 score against itself. Items without an id or without words have none; rows that repeat
    id and text are one."""
    tokenized = (
        items.select(items[f"`{id_col}`"].cast("long").alias("item"), words(ascii_lower(F.regexp_replace(items[f"`{text_col}`"], f"[{SIGNS}]", " "))).alias("words"))
        .filter(F.col("item").isNotNull() & (F.size("words") > 0))
        .distinct()
    )
    sized = tokenized.select("item", "words", F.size("words").alias("length"))
    stats = sized.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    n, mean = stats["n"], stats["mean"] or 1.0
    terms = (
        sized.select("item", "words", "length", F.explode("words").alias("term"))
        .groupBy("item", "words", "length", "term")
        .agg(F.count("*").alias("tf"))
    )
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    return (
        terms.join(df, "term")
        .select("item", "words", "term", impact.alias("impact"))
        .groupBy("item", "words")
        .agg(F.collect_list(F.struct("term", "impact")).alias("impacts"), F.sum("impact").alias("own"))
        .select("item", "words", F.transform("impacts", lambda x: F.struct(x["term"], x["impact"] / F.col("own"))).alias("impacts"))
    )


class Block:
    """Items of about one length in an inverted index, for the workers: postings in item order, with block maxima."""

    def __init__(self, rows: list[tuple[int, list[str], list[tuple[str, float]]]]):
        rows = sorted(rows, key=lambda r: (r[0], r[1]))
        self.item_ids = [r[0] for r in rows]
        self.longest = max(len(r[1]) for r in rows)
        postings: dict[bytes, list[tuple[int, float]]] = {}
        self.wanted: list[Wanted] = []
        for i, (_, item_words, impacts) in enumerate(rows):
            for term, impact in impacts:
                postings.setdefault(term.encode(), []).append((i, impact))
            self.wanted.append(Wanted([w.encode() for w in item_words]))
        self.terms = {term: n for n, term in enumerate(postings)}
        self.items = [np.array([p[0] for p in plist]) for plist in postings.values()]
        self.impacts = [np.array([p[1] for p in plist]) for plist in postings.values()]
        self.block_max = [
            np.maximum.reduceat(x, np.arange(0, len(x), POSTINGS_BLOCK)) for x in self.impacts
        ]
        self.most = np.array([x.max() for x in self.impacts])
        # Postings of rare terms in one array, and what common terms can add to each item.
        sizes = np.array([len(x) for x in self.items])
        self.rare = sizes <= 8 + len(rows) // 1000
        self.sizes, self.offsets = sizes, np.r_[0, np.cumsum(sizes)[:-1]]
        self.all_items, self.all_impacts = np.concatenate(self.items), np.concatenate(self.impacts)
        common = np.repeat(~self.rare, sizes)
        self.common_mass = np.bincount(self.all_items[common], self.all_impacts[common], minlength=len(rows))

    def retrieve(self, terms: list[int], threshold: float = MIN_SCORE) -> list[tuple[int, float]]:
        """All items whose impacts over the distinct ``terms`` sum to the threshold, by block-max WAND."""
        threshold -= 1e-9
        n_items = len(self.item_ids)
        cursors = [[int(self.items[t][0]), t, 0] for t in terms]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(cursors):
                bound += self.most[t]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # The maxima of just the blocks in which the pivot's item would stand.
            local, next_item = 0.0, n_items
            for _, t, at in cursors[: pivot + 1]:
                where = at + int(np.searchsorted(self.items[t][at:], item))
                if where < len(self.items[t]):
                    block = where // POSTINGS_BLOCK
                    local += self.block_max[t][block]
                    after = (block + 1) * POSTINGS_BLOCK
                    if after < len(self.items[t]):
                        next_item = min(next_item, int(self.items[t][after]))
            if pivot + 1 < len(cursors):
                next_item = min(next_item, cursors[pivot + 1][0])
            if local < threshold:
                target = max(item + 1, next_item) if next_item > item else item + 1
            elif cursors[0][0] == item:
                score = sum(self.impacts[t][at] for i, t, at in cursors[: pivot + 1] if i == item)
                if score >= threshold:
                    found.append((item, float(score)))
                target = item + 1
            else:
                target = item
            moved = []
            for c in cursors[: pivot + 1]:
                if c[0] < target:
                    _, t, at = c
                    at += int(np.searchsorted(self.items[t][at:], target))
                    if at == len(self.items[t]):
                        continue
                    c = [int(self.items[t][at]), t, at]
                moved.append(c)
            cursors = moved + cursors[pivot + 1 :]
        return found

    def _reachable(self, half_of: np.ndarray, term_of: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Passages whose rare terms, with all common terms of some item added, could retrieve that item."""
        rare = self.rare[term_of]
        half_of, term_of = half_of[rare], term_of[rare]
        sizes = self.sizes[term_of]
        at = np.repeat(self.offsets[term_of] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        half, item, impact = np.repeat(half_of, sizes), self.all_items[at], self.all_impacts[at]
        # A half belongs to the passage it begins and to the one it ends.
        ends = half > 0
        ends[ends] = owner[half[ends]] == owner[half[ends] - 1]
        key = np.r_[half, half[ends] - 1] * len(self.item_ids) + np.r_[item, item[ends]]
        keys, where = np.unique(key, return_inverse=True)
        sums = np.bincount(where, np.r_[impact, impact[ends]], minlength=len(keys))
        enough = sums + self.common_mass[keys % len(self.item_ids)] >= MIN_SCORE - 1e-9
        out = np.zeros(len(owner), bool)
        out[keys[enough] // len(self.item_ids)] = True
        return out

    def find(self, docs: list[list[bytes]], best: dict[tuple[int, int], tuple]) -> None:
        """Puts the verified items of each document, given as its words, into ``best`` by (document, item id):
        the best score and with it the overlaps of question and answer."""
        step = self.longest
        lengths = np.array([len(d) for d in docs])
        known = self.terms
        ids = np.fromiter((known.get(w, -1) for d in docs for w in d), np.int64, int(lengths.sum()))
        # Half passages of ``step`` words, numbered through all texts; none spans two texts.
        halves = np.maximum(1, -(-lengths // step))
        first_half = np.r_[0, np.cumsum(halves)]
        doc = np.repeat(np.arange(len(docs)), lengths)
        at = np.arange(len(ids)) - np.repeat(np.r_[0, np.cumsum(lengths)[:-1]], lengths)
        half = first_half[doc] + at // step
        hit = ids >= 0
        pairs = np.unique(half[hit] * len(known) + ids[hit])
        half_of, term_of = pairs // len(known), pairs % len(known)
        n_halves = int(first_half[-1])
        owner = np.searchsorted(first_half, np.arange(n_halves), side="right") - 1
        bound = np.bincount(half_of, self.most[term_of], minlength=n_halves + 1)
        # The upper bound of WAND for a passage, from its two halves.
        whole = bound[:-1] + bound[1:]
        borders = np.searchsorted(half_of, np.arange(n_halves + 2))
        likely = whole >= MIN_SCORE - 1e-9
        if self.common_mass.max() < MIN_SCORE:
            likely &= self._reachable(half_of, term_of, owner)
        for h in np.flatnonzero(likely).tolist():
            d = int(owner[h])
            same = h + 1 < n_halves and owner[h + 1] == d
            terms = np.unique(term_of[borders[h] : borders[h + 2 if same else h + 1]])
            if self.most[terms].sum() < MIN_SCORE - 1e-9:
                continue
            found = self.retrieve(terms.tolist())
            if not found:
                continue
            start = (h - int(first_half[d])) * step
            passage = docs[d][start : start + 2 * step]
            grams: dict[int, set] = {}
            for item, score in found:
                ok, q, a = self.wanted[item].judged(passage, grams)
                if ok:
                    key = (d, self.item_ids[item])
                    if key not in best or best[key] < (score, q, a):
                        best[key] = (score, q, a)


class Wanted:
    """What of an item must be found in a passage."""

    def __init__(self, words: list[bytes]):
        self.words = words
        cut = len(words) - math.ceil(len(words) / 4)
        parts = words[:cut], words[cut:]
        self.shingles = [shingles(part) for part in parts]
        self.distinct = [list(set(part)) for part in parts]

    def judged(self, passage: list[bytes], grams: dict[int, set]) -> tuple[bool, float, float]:
        """Whether the passage holds the item, and the shares of the shingles of question and answer it has.

        The question is the first three quarters of the words, the answer the rest. An edit may spoil most
        shingles of a short answer, so the item also counts as found if enough shingles of the whole are
        there and enough words of both parts.
        """
        q, a = (overlap(part, passage, grams) for part in self.shingles)
        if len(self.words) < MIN_WORDS:
            return overlap(shingles(self.words), passage, grams) == 1, q, a
        if min(q, a) >= MIN_OVERLAP:
            return True, q, a
        if min(overlap(part, passage, grams) for part in self.distinct) < MIN_PART:
            return False, q, a
        return overlap(shingles(self.words), passage, grams) >= MIN_OVERLAP, q, a


class Index:
    """A block of the index as one part for each class of lengths, so that one long item costs the others nothing."""

    def __init__(self, rows: list[tuple[int, list[str], list[tuple[str, float]]]]):
        classes: dict[int, list] = {}
        for row in rows:
            size = SHORT
            while size < len(row[1]):
                size *= 4
            classes.setdefault(size, []).append(row)
        self.parts = [Block(classes[size]) for size in sorted(classes)]

    def hits(self, texts: list[bytes]) -> list[list[tuple[int, float, float, float]]]:
        """Verified items of each text: (id, best score, question overlap, answer overlap)."""
        docs = [words_of(text) for text in texts]
        best: dict[tuple[int, int], tuple] = {}
        for part in self.parts:
            part.find(docs, best)
        out: list[list] = [[] for _ in texts]
        for (d, item), values in best.items():
            out[d].append((item, *values))
        return out


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_BLANKED).split()


def shingles(part: list[bytes], size: int = SHINGLE) -> list[bytes]:
    size = min(size, len(part))
    return [b" ".join(part[i : i + size]) for i in range(len(part) - size + 1)] if part else []


def overlap(wanted: list[bytes], passage: list[bytes], grams: dict[int, set]) -> float:
    """Share of the wanted shingles that the passage holds; ``grams`` keeps its shingles by size."""
    if not wanted:
        return 1.0
    size = wanted[0].count(b" ") + 1
    if size not in grams:
        grams[size] = set(shingles(passage, size)) if len(passage) >= size else set()
    return sum(w in grams[size] for w in wanted) / len(wanted)


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[Broadcast, bool]]:
    """The broadcast blocks of the index, one at a time, and whether it is the only one. Rows of an item share a block."""
    index = stored(item_index(items, id_col, text_col), "bm25-index")
    size = index.agg(F.count("*").alias("items"), F.sum(F.size("words").cast("long")).alias("words")).first()
    n = max(1, -(-size["items"] // BLOCK_ITEMS), -(-(size["words"] or 0) // BLOCK_WORDS))
    for b in range(n):
        part = index if n == 1 else index.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == b)
        rows = [(r["item"], r["words"], [tuple(x) for x in r["impacts"]]) for r in part.collect()]
        if rows:
            yield items.sparkSession.sparkContext.broadcast(Index(rows)), n == 1
    release(index)


def _leaks_of(block):
    @F.arrow_udf(ArrayType(_HIT))
    def found(texts: pa.Array) -> pa.Array:
        names = [f.name for f in _HIT.fields]
        hits = [
            [dict(zip(names, hit)) for hit in doc]
            for part in slices(texts)
            for doc in block.value.hits(part)
        ]
        kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.array(hits, pa.list_(pa.struct(list(zip(names, kinds)))))

    return found


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """One row for each row of ``docs`` and item it leaks: id, item_id, score and both overlaps.

    Words are runs of other than white space and ASCII signs, A-Z lower-cased. Every passage of the whole
    text is tried; of several passages with one item the best score counts. Null and empty texts leak
    nothing, items without id or words are not leaked, and without items there are no rows. Items of under
    ``MIN_WORDS`` words are leaked by an exact run of their words.
    """
    text = docs[f"`{text_col}`"].cast("string")
    found = None
    for block, only in _blocks(items, item_col, "text"):
        hits = docs.select(docs[f"`{id_col}`"].alias(id_col), F.inline(_leaks_of(block)(text)))
        if not only:
            hits = stored(hits, "leaks")
            block.unpersist()
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.select(docs[f"`{id_col}`"].alias(id_col), F.inline(F.array().cast(ArrayType(_HIT))))
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that leak no item, with their own columns; no shuffle. Each block sees what the one before has left."""
    for block, only in _blocks(items, "item_id", "text"):
        docs = docs.filter(F.size(_leaks_of(block)(docs[f"`{text_col}`"].cast("string"))) == 0)
        if not only:
            docs = stored(docs, "clean")
            block.unpersist()
    return docs
