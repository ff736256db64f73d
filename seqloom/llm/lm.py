"""Bigram language model in a log-frequency Bloom filter, dealt out by hash segment.

An n-gram with quantised count level q is inserted q times, as (n-gram, 1) to (n-gram, q); its count is
read back by asking for level 1, 2, ... until one is missing. Tasks count their own texts, sorted blocks of
counts are shuffled by hash segment and merged, and each segment builds its filter at once from its own
inserts, so counts of pairs are never stored. Every n-gram is kept: the filter grows with the input. It
is not broadcast, as nothing bounds its size; it is held as rows, one for each segment and kind, and their
number grows so that each stays bounded. Slices of texts send their distinct n-grams to the
segments and get the levels back in the same order, one byte each.

Pairs are told apart by their segment and 40 more bits, tokens are counted by all 64. Sorted keys travel
as differences, about three bytes each.

The unigram base score is exact. Counts of frequent tokens are broadcast, up to a fixed number of
them; the tokens of each text that are not among them meet the full table of counts in a join.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from seqloom.llm.common import slices
from seqloom.session import release, stored

#: Parts of ten that are held out, and the pseudo-count of the base score.
HELD_OUT_OF = 10
ALPHA = 0.1
#: Weight of the pair estimate against the token estimate.
PAIR_WEIGHT = 0.2
#: Counts are quantised to powers of this.
STEP = math.sqrt(2.0)
HASHES = 4
BITS_PER_INSERT = 10
#: Bytes of text for each hash segment; bounds the counts and the filter of a segment.
SEGMENT_BYTES = 1 << 26
#: Bytes of text in a slice, and the n-grams that are looked up at once.
SLICE_BYTES, LOOKUP = 8_000_000, 1 << 20
#: Bits of a hash that the filter leaves out; the other 40 are told apart within a segment.
LEFT_OUT = np.uint64(24)
#: Bound of the exact counts that are broadcast.
MAX_HEAD = 1 << 18
#: Tokens that a task counts at once.
COUNT_TOKENS = 3_000_000

UNIGRAM, PAIR = 0, 1
END = np.uint64(0x7E1D0F5A3C9B2E64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_BLOCKS = "kind int, segment int, n bigint, keys binary, counts binary"
_MODEL = "kind int, segment int, n_keys bigint, total bigint, keys binary, counts binary, bits binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text closed by the end token; and where each text ends."""
    digest, end = xxhash.xxh64_intdigest, np.array([END])
    parts, ends, size = [], [], 0
    for text in texts:
        words = text.lower().split()
        parts += [np.fromiter(map(digest, words), np.uint64, len(words)), end]
        size += len(words) + 1
        ends.append(size)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(ends, np.int64)


def pairs_of(tokens: np.ndarray) -> np.ndarray:
    """A key for each token with the one before it; texts follow each other, so the first follows an end."""
    before = np.r_[END, tokens[:-1]]
    return _mixed(before * _M2 + tokens)


def held_out(id_col: Column) -> Column:
    """Whether a document is held out; one without an id always is."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(HELD_OUT_OF)) == 0


def coded(keys: np.ndarray) -> bytes:
    """Sorted keys of 40 bits as differences: their low three bytes plain, the others packed."""
    steps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    packer = zlib.compressobj(1, zlib.DEFLATED, 15, 8, zlib.Z_HUFFMAN_ONLY)
    low, high = (np.ascontiguousarray(steps[:, part].T).tobytes() for part in (slice(0, 3), slice(3, 5)))
    return low + packer.compress(high) + packer.flush()


def decoded(data: bytes, n: int) -> np.ndarray:
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :3] = np.frombuffer(data, np.uint8, 3 * n).reshape(3, n).T
    steps[:, 3:5] = np.frombuffer(zlib.decompress(data[3 * n :]), np.uint8).reshape(2, n).T
    return np.cumsum(steps.view(np.uint64)[:, 0], dtype=np.uint64)


def _coded_counts(counts: np.ndarray) -> bytes:
    """One byte for each count, packed; those of 255 and more in full before them."""
    large = counts[counts >= 255].astype(np.uint64)
    small = np.minimum(counts, 255).astype(np.uint8)
    return len(large).to_bytes(8, "little") + large.tobytes() + zlib.compress(small.tobytes(), 1)


def _decoded_counts(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    counts = np.frombuffer(zlib.decompress(data[8 + 8 * n :]), np.uint8).astype(np.uint64)
    counts[counts == 255] = np.frombuffer(data, np.uint64, n, 8)
    return counts


def _dealt(keys: np.ndarray, n_segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted keys by segment, in which they stay sorted; and where each segment ends in it."""
    narrow = np.uint16 if n_segments <= 1 << 16 else np.uint32
    segment = (keys % np.uint64(n_segments)).astype(narrow)
    return np.argsort(segment, kind="stable"), np.cumsum(np.bincount(segment, minlength=n_segments))


def _counted(tokens: list[np.ndarray], n_segments: int) -> Iterator[tuple]:
    joined = np.concatenate(tokens)
    for kind in (UNIGRAM, PAIR):
        keys, counts = np.unique(joined if kind == UNIGRAM else pairs_of(joined), return_counts=True)
        order, ends = _dealt(keys, n_segments)
        keys, counts = keys[order], counts[order]
        for s, (a, b) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())):
            if b > a:
                data = keys[a:b].tobytes() if kind == UNIGRAM else coded(keys[a:b] >> LEFT_OUT)
                yield kind, s, b - a, data, _coded_counts(counts[a:b])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields]
    )


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


def _by_segment(rows: DataFrame, n_segments: int, *order: Column | str) -> DataFrame:
    """Rows of a segment in one partition, sorted. Where segments outnumber the partitions by far, several share one."""
    parts = min(n_segments, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionById(parts, F.pmod(F.col("segment"), F.lit(parts))).sortWithinPartitions("segment", *order)


def learn(texts: DataFrame, n_segments: int) -> DataFrame:
    """The model as rows, one for each kind and segment that has n-grams: how many, their total count and
    their filter; those of tokens have the exact counts too. ``texts`` has one column, ``text``."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch.column(0)):
                held.append(tokens_of(part)[0])
                size += len(held[-1])
                if size >= COUNT_TOKENS:
                    yield _batch(list(_counted(held, n_segments)), _BLOCKS)
                    held, size = [], 0
        if held:
            yield _batch(list(_counted(held, n_segments)), _BLOCKS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks come sorted by segment and kind; one of them is held at a time.
        now, keys, counts = None, [], []

        def model() -> pa.RecordBatch:
            all_keys, all_counts = _merged(np.concatenate(keys), np.concatenate(counts))
            exact = (None, None)
            if now[0] == UNIGRAM:
                exact = all_keys.tobytes(), all_counts.tobytes()
            short = all_keys >> LEFT_OUT if now[0] == UNIGRAM else all_keys
            row = (*now, len(all_keys), int(all_counts.sum()), *exact, filter_of(short, all_counts, now[0]))
            return _batch([row], _MODEL)

        for batch in batches:
            for kind, segment, n, k, c in zip(*(batch.column(i) for i in range(5))):
                at = (kind.as_py(), segment.as_py())
                if now is not None and at != now:
                    yield model()
                    keys, counts = [], []
                now = at
                data = k.as_py()
                keys.append(np.frombuffer(data, np.uint64) if at[0] == UNIGRAM else decoded(data, n.as_py()))
                counts.append(_decoded_counts(c.as_py()))
        if now is not None:
            yield model()

    return _by_segment(texts.mapInArrow(local, _BLOCKS), n_segments, "kind").mapInArrow(merge, _MODEL)


def _levels(counts: np.ndarray, least: int) -> np.ndarray:
    """Quantised level of each count: 1 for ``least``, one more for each factor ``STEP``."""
    ratio = np.maximum(counts.astype(np.float64), 1.0) / least
    return np.where(ratio >= 1, 1 + np.floor(np.log(np.maximum(ratio, 1.0)) / math.log(STEP) + 1e-9), 0).astype(np.int64)


def _positions(keys: np.ndarray, kind: int, level: int, hash_no: int, n_bits: int) -> np.ndarray:
    seed = (kind * 7919 + hash_no * 104729 + level * 15485863) * int(_M2) % (1 << 64)
    return (_mixed(keys + np.uint64(seed)) % np.uint64(n_bits)).astype(np.int64)


def filter_of(keys: np.ndarray, counts: np.ndarray, kind: int) -> bytes:
    """The filter of keys (hashes without the bits left out) with these counts, sized by their inserts."""
    levels = _levels(counts, 1)
    n_bits = max(64, -(-int(levels.sum()) * BITS_PER_INSERT // 64) * 64)
    bits = np.zeros(n_bits, np.bool_)
    q = 1
    while len(keys):
        for start in range(0, len(keys), LOOKUP):
            for i in range(HASHES):
                bits[_positions(keys[start : start + LOOKUP], kind, q, i, n_bits)] = True
        q += 1
        keys, levels = keys[levels >= q], levels[levels >= q]
    return np.packbits(bits, bitorder="little").tobytes()


def levels_in(bits: bytes, keys: np.ndarray, kind: int) -> np.ndarray:
    """The quantised level (a byte) of each key's count as the filter has it; 0 for those not found."""
    held, n_bits = np.frombuffer(bits, np.uint8), 8 * len(bits)
    level = np.zeros(len(keys), np.uint8)
    for start in range(0, len(keys) if n_bits else 0, LOOKUP):
        part, found = keys[start : start + LOOKUP], level[start : start + LOOKUP]
        alive = np.arange(len(part))
        for q in range(1, 130):
            for i in range(HASHES):
                at = _positions(part[alive], kind, q, i, n_bits)
                alive = alive[(held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
                if not len(alive):
                    break
            if not len(alive):
                break
            found[alive] = q
    return level


def _middle(level: np.ndarray, least: int = 1) -> np.ndarray:
    """The middle of the counts that have this level."""
    low = least * STEP ** (level - 1.0)
    return np.where(level == 0, 0.0, np.where(low * STEP < least + 1, least, low * math.sqrt(STEP)))


def _sliced(rows: DataFrame) -> DataFrame:
    """Slices of the rows (id, version, held_out, text): their columns without the text as arrays, where each
    text ends, the distinct tokens and the place of each token among them (compressed). Stored, as slices are named at random."""
    kept = rows.drop("text")
    names = kept.columns
    schema = "slice string, " + ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in kept.schema.fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(batch.num_columns - 1), SLICE_BYTES):
                tokens, ends = tokens_of(part)
                distinct, places = np.unique(tokens, return_inverse=True)
                offsets = pa.array([0, len(part)], pa.int32())
                lists = [
                    pa.ListArray.from_arrays(offsets, pa.concat_arrays([c.slice(at, len(part))]))
                    for c in batch.columns[:-1]
                ]
                at += len(part)
                data = [ends.tobytes(), distinct.tobytes(), zlib.compress(places.astype(np.int32).tobytes(), 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().hex]), *lists, *[pa.array([x], pa.binary()) for x in data]],
                    names=["slice", *names, "ends", "tokens", "places"],
                )

    return stored(rows.mapInArrow(cut, schema + ", ends binary, tokens binary, places binary"), "slices")


def _distinct_grams(tokens: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A slice's distinct tokens and the place of each of its tokens; the same of its pairs."""
    distinct, at = np.frombuffer(tokens, np.uint64), np.frombuffer(zlib.decompress(places), np.int32)
    return distinct, at, *np.unique(pairs_of(distinct[at]), return_inverse=True)


_ASKED = "segment int, kind int, slice string, n bigint, data binary"
_ANSWERED = "slice string, kind int, segment int, levels binary"


def _levels_of(sliced: DataFrame, model: DataFrame, n_segments: int) -> DataFrame:
    """Rows (slice, kind, segment, levels): one byte for each of the slice's distinct n-grams of the segment."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, tokens, places in zip(*(batch.column(c) for c in ("slice", "tokens", "places"))):
                words, _, pairs, _ = _distinct_grams(tokens.as_py(), places.as_py())
                for kind, keys in ((UNIGRAM, words), (PAIR, pairs)):
                    order, ends = _dealt(keys, n_segments)
                    short = (keys >> LEFT_OUT)[order]
                    borders = zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())
                    rows = [
                        (s, kind, name.as_py(), b - a, coded(short[a:b])) for s, (a, b) in enumerate(borders) if b > a
                    ]
                    yield _batch(rows, _ASKED)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The filters of a segment come before what is asked of it; one segment is held at a time.
        now, filters, asked, size = None, {}, {}, 0

        def answers() -> pa.RecordBatch:
            rows = []
            for kind, questions in asked.items():
                keys = np.concatenate([k for _, k in questions])
                found = levels_in(filters.get(kind, b""), keys, kind)
                at = 0
                for name, k in questions:
                    rows.append((name, kind, now, zlib.compress(found[at : at + len(k)].tobytes(), 1)))
                    at += len(k)
            return _batch(rows, _ANSWERED)

        for batch in batches:
            for segment, kind, name, n, data in zip(*batch.columns):
                segment, kind, name = segment.as_py(), kind.as_py(), name.as_py()
                if segment != now:
                    if asked:
                        yield answers()
                    now, filters, asked, size = segment, {}, {}, 0
                if name is None:
                    filters[kind] = data.as_py()
                    continue
                asked.setdefault(kind, []).append((name, decoded(data.as_py(), n.as_py())))
                size += n.as_py()
                if size >= LOOKUP:
                    yield answers()
                    asked, size = {}, 0
        if asked:
            yield answers()

    questions = sliced.select("slice", "tokens", "places").mapInArrow(ask, _ASKED)
    bits = model.select(
        "segment", "kind", F.lit(None).cast("string").alias("slice"), F.lit(0).cast("long").alias("n"), F.col("bits").alias("data")
    )
    return _by_segment(bits.unionByName(questions), n_segments, F.col("slice").asc_nulls_first()).mapInArrow(
        answer, _ANSWERED
    )


def _token_counts(model: DataFrame) -> DataFrame:
    """The exact counts of tokens as rows (token, n)."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column(0), batch.column(1)):
                keys, counts = (np.frombuffer(x.as_buffer(), np.int64) for x in (k, c))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["token", "n"])

    return model.filter(F.col("kind") == UNIGRAM).select("keys", "counts").mapInArrow(local, "token bigint, n bigint")


def _head(counts: DataFrame) -> DataFrame:
    """The most frequent tokens, all from some power of two on, at most ``MAX_HEAD`` of them."""
    power = F.length(F.bin("n")) - 1
    sizes = counts.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect()  # 64 rows at most
    least, size = 1 << 62, 0
    for row in sizes:
        size += row["count"]
        if size > MAX_HEAD:
            break
        least = 1 << row["power"]
    return counts.filter(F.col("n") >= least)


_SCORED = StructType(
    [
        StructField("n_tokens", LongType()),
        StructField("known", LongType()),
        StructField("base", DoubleType()),
        StructField("score", DoubleType()),
        StructField("rest", ArrayType(LongType())),
    ]
)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score``.

    Tokens are words (runs of other than white space, A-Z lower-cased) and one end for each text; a null
    text is an empty one and has its end only. Learns from all rows that are not held out (crc32 of the
    id modulo 10 is not 0; a row without an id is held out). ``score`` sums log10 of
    ``w c(v,x)/c(v) + (1-w) p(x)`` over tokens x after v, all three counts read from the filter, which holds
    every n-gram of the training rows; any other has count 0 and the pseudo-count of the base. Without training rows every
    token is unknown. Repeated ids and rows each keep their row.
    """
    spark = docs.sparkSession
    rows = docs.select(
        docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")).alias("text")
    ).select("id", held_out(F.col("id")).alias("held_out"), "text")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n_segments = max(8, n_parts, -(-n_bytes // SEGMENT_BYTES))
    model = stored(learn(rows.filter("NOT held_out").select("text"), n_segments), "model")
    totals = (
        model.filter(F.col("kind") == UNIGRAM)
        .agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_keys"), F.lit(0)).alias("v"))
        .first()
    )
    n_train, n_distinct = totals["n"], totals["v"]
    head = _head(_token_counts(model)).toPandas().sort_values("token")
    head_tokens = head["token"].to_numpy(np.int64)
    head_counts = head["n"].to_numpy(np.int64)
    exact_head = spark.sparkContext.broadcast((head_tokens, head_counts))
    whole = math.log10(n_train + ALPHA * (n_distinct + 1))

    def scored(row: dict, levels: dict[int, np.ndarray]) -> pa.StructArray:
        head_tokens, head_counts = exact_head.value
        distinct, where, pairs, pair_where = _distinct_grams(row["tokens"], row["places"])
        tokens, ends = distinct[where], np.frombuffer(row["ends"], np.int64)
        read, pair_read = np.zeros(len(distinct)), np.zeros(len(pairs))
        # The answers are in the order of the segments, as the questions were.
        read[_dealt(distinct, n_segments)[0]] = _middle(levels[UNIGRAM])
        pair_read[_dealt(pairs, n_segments)[0]] = _middle(levels[PAIR])
        signed = distinct.view(np.int64)
        at = np.minimum(np.searchsorted(head_tokens, signed), max(0, len(head_tokens) - 1))
        in_head = head_tokens[at] == signed if len(head_tokens) else np.zeros(len(signed), bool)
        exact = np.where(in_head, head_counts[at] if len(head_tokens) else 0, 0)
        token_p = (read + ALPHA) / (n_train + ALPHA * (n_distinct + 1))
        # The context's count is that of the token before; at the start of the slice that of the end.
        end_count = read[np.searchsorted(distinct, END)]
        context = np.r_[end_count, read[where][:-1]]
        pair = pair_read[pair_where]
        share = np.minimum(1.0, pair / np.maximum(context, np.maximum(pair, 1.0)))
        log_p = np.log10(PAIR_WEIGHT * share + (1 - PAIR_WEIGHT) * token_p[where])
        starts = np.r_[0, ends[:-1]]
        known = in_head[where]
        log_base = np.where(known, np.log10(exact[where] + ALPHA), 0.0)
        rest = tokens.view(np.int64)[~known]
        rest_ends = np.cumsum(~known)[ends - 1]
        offsets = np.r_[0, rest_ends].astype(np.int32)
        return pa.StructArray.from_arrays(
            [
                pa.array(ends - starts),
                pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                pa.array(np.add.reduceat(log_base, starts)),
                pa.array(np.add.reduceat(log_p, starts)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(rest)),
            ],
            names=["n_tokens", "known", "base", "score", "rest"],
        )

    names = ["id", "version", "held_out"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A slice comes before its answers, and these by kind and segment.
        row, lists, held = None, None, {}

        def result() -> pa.RecordBatch:
            levels = {k: np.frombuffer(b"".join(held[k]), np.uint8).astype(np.int64) for k in (UNIGRAM, PAIR)}
            return pa.RecordBatch.from_arrays([*lists, scored(row, levels)], names=[*names, "s"])

        for batch in batches:
            for i in range(batch.num_rows):
                kind = batch.column("kind")[i].as_py()
                if kind >= 0:
                    held[kind].append(zlib.decompress(batch.column("levels")[i].as_py()))
                    continue
                if row is not None:
                    yield result()
                row = {n: batch.column(n)[i].as_py() for n in ("ends", "tokens", "places")}
                lists = [pa.concat_arrays([batch.column(n)[i].values]) for n in names]
                held = {UNIGRAM: [], PAIR: []}
        if row is not None:
            yield result()

    id_type = rows.schema["id"].dataType.simpleString()
    sliced = _sliced(rows.select("id", F.xxhash64("text").alias("version"), "held_out", "text"))
    answers = _levels_of(sliced, model, n_segments)
    own = sliced.withColumns({"kind": F.lit(-1), "segment": F.lit(-1)})
    first = stored(
        own.unionByName(answers, allowMissingColumns=True)
        .repartition(n_parts, "slice")
        .sortWithinPartitions("slice", "kind", "segment")
        .mapInArrow(score, f"id {id_type}, version bigint, held_out boolean, s {_SCORED.simpleString()}")
        .select("id", "version", "held_out", "s.*"),
        "scored",
    )
    release(sliced)
    asked = (
        first.filter(F.size("rest") > 0)
        .dropDuplicates(["id", "version"])
        .select("id", "version", F.explode("rest").alias("token"))
    )
    found = (
        asked.join(_token_counts(model), "token")
        .groupBy(F.col("id").alias("asked_id"), F.col("version").alias("asked_version"))
        .agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("n") + ALPHA)).alias("more_base"))
    )
    same = F.col("id").eqNullSafe(F.col("asked_id")) & (F.col("version") == F.col("asked_version"))
    more = F.coalesce("more_known", F.lit(0))
    unknown = F.size("rest") - more
    return first.join(found, same, "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + more).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (
            F.col("base")
            + F.coalesce("more_base", F.lit(0.0))
            + unknown * math.log10(ALPHA)
            - F.col("n_tokens") * whole
        ).alias("base_score"),
        "score",
    )
