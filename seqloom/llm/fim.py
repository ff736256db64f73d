"""Fill-in-the-middle transformation by memoised content-defined chunks.

A unit is white space with the word behind it, or white space at the end of the text. A text is cut
into chunks where a rolling hash of its bytes says so, hence equal passages of different texts give
equal chunks wherever they stand. For each chunk a summary is kept in a content cache of the worker:
code points, words, and whether its first and last byte belong to a word. Summaries combine from left
to right (a word that goes on across a chunk border counts once), and their running sums tell in which
chunk a cut falls. Only the chunks that hold a cut are looked into.

Every row is worked on alone, so nothing is shuffled and a lost task is simply run again. The cache
only saves work: a hit is taken after its content was compared, so no result depends on it.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.llm.common import SPACE_CHARS, slices

#: Bytes that the rolling hash looks at; a power of two.
WINDOW = 32
#: A chunk ends where the hash has this many leading zero bits: one place in 1024 on average.
ZERO_BITS = 10
#: Chunks are cut at this many bytes where the hash gives no place.
MAX_CHUNK = 16_384
#: Bytes of chunk contents that a worker keeps.
CACHE_BYTES = 8_000_000
#: Bytes of texts that are hashed at once; hashing takes some sixteen times as much memory.
SLICE_BYTES = 500_000
#: The markers of the output, and the seed of the draws.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACE = frozenset(SPACE_CHARS.encode())


class Summary(NamedTuple):
    """What the running sums need of a chunk."""

    chars: int
    words: int
    opens: bool
    closes: bool


def summarise(chunk: bytes) -> Summary:
    return Summary(
        len(chunk.decode()),
        len(chunk.split()),
        chunk[0] not in _SPACE,
        chunk[-1] not in _SPACE,
    )


class ContentCache:
    """Summaries by content, the least used given up beyond ``limit`` bytes of contents."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.size = limit, 0
        self.held: OrderedDict[int, tuple[bytes, Summary]] = OrderedDict()
        self.hits = self.misses = 0

    def summary(self, chunk: bytes) -> Summary:
        key = hash(chunk)
        found = self.held.get(key)
        if found is not None and found[0] == chunk:
            self.hits += 1
            self.held.move_to_end(key)
            return found[1]
        self.misses += 1
        out = summarise(chunk)
        if found is not None:
            self.size -= len(found[0])
        self.held[key] = (chunk, out)
        self.held.move_to_end(key)
        self.size += len(chunk)
        while self.size > self.limit and len(self.held) > 1:
            self.size -= len(self.held.popitem(last=False)[1][0])
        return out


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """A hash of each ``WINDOW`` consecutive bytes, made by doubling the width."""
    value = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    factor, width = np.array([0x01000193], np.uint32), 1
    while width < WINDOW and len(value) > width:
        value = value[:-width] * factor + value[width:]
        factor, width = factor * factor, width * 2
    return value * np.uint32(0x85EBCA6B) if width == WINDOW else value[:0]


def chunk_ends(texts: list[bytes]) -> list[list[int]]:
    """Where the chunks of each text end. All are hashed at once; a window never spans two texts."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    # A place is the byte behind its window; it moves on to the next start of a character.
    places = np.flatnonzero(rolling_hash(joined) >> np.uint32(32 - ZERO_BITS) == 0) + WINDOW
    bounds = np.cumsum([0, *map(len, texts)])
    first = np.searchsorted(places, bounds[:-1] + WINDOW)
    last = np.searchsorted(places, bounds[1:])
    out = []
    for text, start, a, b in zip(texts, bounds.tolist(), first.tolist(), last.tolist()):
        ends, at = [], 0
        for place in [*(places[a:b] - start).tolist(), len(text)]:
            while place - at > MAX_CHUNK:
                ends.append(at := _char_start(text, at + MAX_CHUNK))
            place = _char_start(text, place)
            if place > at:
                ends.append(at := place)
        out.append(ends)
    return out


def _char_start(text: bytes, at: int) -> int:
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return at


class Text:
    """One text as chunks with running sums: byte, code point and word counts before each chunk."""

    def __init__(self, data: bytes, ends: list[int], cache: ContentCache):
        self.data = data
        self.ends = ends
        self.before: list[tuple[int, int, int, bool]] = []
        at = chars = words = 0
        inside = False
        for end in ends:
            summary = cache.summary(data[at:end])
            # ``inside``: the word at the start of the chunk began in an earlier one
            goes_on = inside and summary.opens
            self.before.append((at, chars, words, goes_on))
            words += summary.words - goes_on
            chars += summary.chars
            inside, at = summary.closes, end
        self.chars = chars
        self.words = words
        #: Units: one for each word, one for white space at the end.
        self.units = words + (bool(data) and not inside)

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the first ``units`` units."""
        if units <= 0:
            return 0, 0
        if units > self.words or units == self.units:
            return len(self.data), self.chars
        # The word may end in a later chunk than it begins in: what begins before chunk k is words[k].
        low, high = 0, len(self.before) - 1
        while low < high:
            mid = (low + high + 1) // 2
            if self.before[mid][2] < units:
                low = mid
            else:
                high = mid - 1
        at, chars, words, goes_on = self.before[low]
        wanted = units - words + goes_on
        match = None
        for match in _WORD.finditer(self.data, at, self.ends[low]):
            wanted -= 1
            if not wanted:
                break
        end = match.end()
        chars += len(self.data[at:end].decode())
        # A word that reaches the end of its chunk may go on in the next ones.
        while end == self.ends[low] and low + 1 < len(self.ends) and self.before[low + 1][3]:
            low += 1
            more = _WORD.match(self.data, end, self.ends[low]).end()
            chars += len(self.data[end:more].decode())
            end = more
        return end, chars


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of seed and key; a null key is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(text: Column, key: Column, fim_rate: int = 50, spm_rate: int = 80, seed: int = SEED) -> Column:
    """A struct ``n, form, prefix_chars, middle_chars, output`` for each text.

    ``n`` counts the units. Two draws choose the ends of prefix and middle among the n + 1 places
    between units, a third leaves all but ``fim_rate`` percent of the texts plain, a fourth makes
    ``spm_rate`` percent of the others spm (suffix first), the rest psm. Texts that hold a marker
    and empty texts are plain; a null text is an empty one. The draws depend on ``key`` alone: rows
    with equal keys and texts give equal results, and rows without a key draw as the empty key does.
    Texts of any length are worked on whole.
    """
    marks = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))

    @F.arrow_udf("struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>")
    def transform_of(
        texts: pa.Array, first: pa.Array, second: pa.Array, third: pa.Array, fourth: pa.Array
    ) -> pa.Array:
        cache = worker_cache()
        h1, h2, h3, h4 = (h.to_pylist() for h in (first, second, third, fourth))
        counts, forms, prefixes, middles, parts = [], [], [], [], []
        row = 0
        for some in slices(texts, SLICE_BYTES):
            outputs = []
            for data, ends in zip(some, chunk_ends(some)):
                whole = Text(data, ends, cache)
                n = whole.units
                counts.append(n)
                if not data or h3[row] % 100 >= fim_rate or any(m in data for m in marks):
                    forms.append("plain")
                    prefixes.append(None)
                    middles.append(None)
                    outputs.append(data)
                else:
                    places = sorted((h1[row] % (n + 1), h2[row] % (n + 1)))
                    (a, a_chars), (b, b_chars) = map(whole.cut, places)
                    p, m, s = data[:a], data[a:b], data[b:]
                    spm = h4[row] % 100 < spm_rate
                    forms.append("spm" if spm else "psm")
                    prefixes.append(a_chars)
                    middles.append(b_chars - a_chars)
                    order = ((marks[1], s), (marks[0], p)) if spm else ((marks[0], p), (marks[1], s))
                    outputs.append(b"".join([x for pair in order for x in pair] + [marks[2], m]))
                row += 1
            parts.append(pa.array(outputs, pa.binary()).cast(pa.string()))
        joined = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
        parts.clear()
        # idle workers stay for a while beside the busy ones: what the last batch took is given back
        pa.default_memory_pool().release_unused()
        return pa.StructArray.from_arrays(
            [
                pa.array(counts, pa.int64()),
                pa.array(forms, pa.string()),
                pa.array(prefixes, pa.int64()),
                pa.array(middles, pa.int64()),
                joined,
            ],
            names=["n", "form", "prefix_chars", "middle_chars", "output"],
        )

    return transform_of(text, *draws(key, seed))


_cache: ContentCache | None = None


def worker_cache() -> ContentCache:
    """One cache for each worker process."""
    global _cache
    if _cache is None:
        _cache = ContentCache()
    return _cache


def _after(text: Column, mark: str) -> Column:
    """What stands behind the first ``mark``; markers cannot overlap, as they start with ``<`` and end with ``>``."""
    return text.substr(F.locate(mark, text) + len(mark), F.length(text))


def _before(text: Column, mark: str) -> Column:
    return text.substr(F.lit(1), F.locate(mark, text) - 1)


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` has been given (null: the empty one), from its output and form."""
    tail = _after(output, MIDDLE)
    body = _before(output, MIDDLE)
    psm = F.concat(_after(_before(body, SUFFIX), PREFIX), tail, _after(body, SUFFIX))
    spm = F.concat(_after(body, PREFIX), tail, _after(_before(body, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
