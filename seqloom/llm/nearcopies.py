"""Near copies by SimHash and anchor points of a covering code: anchors find pairs, the texts decide.

Two texts are near copies if the sets of their five-word shingles have a similarity of 0.8 or more. The
fingerprint of a text is the SimHash of these shingles: 1024 sums of signs, one for each bit of a shingle's
hash, and the 1024 signs of the sums. Near copies differ in a bit with a probability of 0.15 at 0.8, too
much for the code of ``simhash``, whose anchors lie within two bits. So the anchors are words of a code with a
wide covering radius, the first-order Reed-Muller code of length 256: 512 words, and every string of 256
bits lies within 120 bits of one. Each of 96 blocks takes 256 of the sums, with signs of its own, and is
replicated to the anchor that its sums agree with most, found by a Walsh-Hadamard transform. Near copies at 0.8
have the same anchor in a block with a probability of 0.39. A band is made of the anchors of three
blocks, and no two of the 128 bands have two blocks in common.

A band may be shared by many texts. In two rounds its texts are compared with one of them only, first any,
then the one that most were found near to, which joins a group of near copies with one pair for each member.
Where texts are still apart after that, all pairs of a place are compared inside a task, first by the
fingerprints, then by the shingles themselves, and only links that join what is not joined become
rows. A crowded place is dealt to blocks of bounded size, and every two blocks meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, ShortType, StructField, StructType

from seqloom.llm.common import slices
from seqloom.llm.components import components
from seqloom.llm.simhash import kept_rows
from seqloom.session import stored

SHINGLE = 5
SEED = 42
#: Near copies share four fifths of their shingles.
SIMILAR, OUT_OF = 4, 5
#: Bits of the fingerprint, in longs; blocks of so many of its sums; three blocks to a band, at these distances, whose
#: differences are all distinct.
LONGS = 16
BITS = 64 * LONGS
LENGTH, BLOCKS, BANDS = 256, 96, 128
APART = ((0, 5, 18), (0, 7, 31))
#: Bits in which two fingerprints may differ for the texts to be read: at 0.8 it is 155 with a deviation of 11.5;
#: sums of few shingles tie more often (192 with 12.5 for four of five).
MOST_DIFFER, FEW, MOST_DIFFER_FEW = 207, 64, 250
#: Rounds in which a band's texts are compared with one of them.
ROUNDS = 2
#: Texts of a place that are compared with one another in one go; the texts of a larger place are dealt to blocks.
CROWDED = 256

_RANDOM = np.random.default_rng(20240607)
_FACTORS = _RANDOM.integers(0, 1 << 63, LONGS, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 63, LONGS, np.uint64)
_TAKEN = np.array([_RANDOM.permutation(BITS)[:LENGTH] for _ in range(BLOCKS)])
_SIGNS = _RANDOM.choice(np.array([-1, 1], np.float32), (BLOCKS, LENGTH, 1))

_SIGNATURE = StructType(
    [
        StructField("key", LongType()),
        StructField("n", LongType()),
        StructField("anchors", ArrayType(ShortType())),
        StructField("sketch", ArrayType(LongType())),
    ]
)
_ARROW = pa.struct([("key", pa.int64()), ("n", pa.int64()), ("anchors", pa.list_(pa.int16())), ("sketch", pa.list_(pa.int64()))])


def shingle_set(text: bytes) -> set[tuple[bytes, ...]]:
    """The five-word shingles of a text, A-Z lower-cased; a text of fewer words is one shingle."""
    words = text.lower().split()
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE))))


def _hashes(text: bytes) -> np.ndarray:
    """The sorted hashes of a text's shingles."""
    values = np.array([xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in shingle_set(text)], np.uint64)
    values.sort()
    return values


def _sums(values: np.ndarray) -> np.ndarray:
    """How often each bit is set in the longer hashes made of shingle hashes, less how often it is not."""
    ones = np.zeros(BITS, np.int64)
    for low in range(0, len(values), 255):  # so many fit a byte
        longer = values[low : low + 255, None] * _FACTORS + _TERMS
        longer ^= longer >> np.uint64(32)
        longer *= np.uint64(0xD6E8FEB86659FD93)
        longer ^= longer >> np.uint64(29)
        bits = np.unpackbits(longer.view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return 2 * ones - len(values)


def _transformed(columns: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each column: its agreement with each word of the code."""
    other, half = np.empty_like(columns), 1
    while half < len(columns):
        old, new = (x.reshape(-1, 2, half, x.shape[1]) for x in (columns, other))
        np.add(old[:, 0], old[:, 1], out=new[:, 0])
        np.subtract(old[:, 0], old[:, 1], out=new[:, 1])
        columns, other, half = other, columns, 2 * half
    return columns


def _anchors(sums: np.ndarray) -> np.ndarray:
    """The anchor of each block, twice the number of a word or one more for its complement; a row for each text."""
    columns = np.ascontiguousarray(sums.T, np.float32)
    anchors = np.empty((BLOCKS, len(sums)), np.int16)
    for block in range(BLOCKS):
        agreement = _transformed(columns[_TAKEN[block]] * _SIGNS[block])
        word = np.argmax(np.abs(agreement), axis=0)
        anchors[block] = 2 * word + (np.take_along_axis(agreement, word[None], 0)[0] < 0)
    return anchors.T


def _members(points: DataFrame) -> DataFrame:
    """A row (band, key) for each band of each point: the band's number and its three anchors as one long."""
    numbers = F.sequence(F.lit(0), F.lit(BANDS - 1))
    rows = points.where(F.size("anchors") > 0).select("key", "anchors", F.explode(numbers).alias("number"))
    band = F.col("number").cast("long")
    for first, second in zip(*APART):
        place = F.col("number") + F.when(F.col("number") < BLOCKS, first).otherwise(second)
        band = band * (2 * LENGTH) + F.get("anchors", place % BLOCKS)
    return rows.select(band.alias("band"), "key")


def _signatures(texts: list[bytes]) -> pa.StructArray:
    keys, counts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    sums = np.zeros((len(texts), BITS), np.int32)
    for i, text in enumerate(texts):
        values = _hashes(text)
        counts[i] = len(values)
        if len(values):
            keys[i] = np.array([xxhash.xxh64_intdigest(values.tobytes(), SEED)], np.uint64).view(np.int64)[0]
            sums[i] = _sums(values)
    sketches = np.packbits(sums > 0, axis=1, bitorder="little").view(np.int64)
    filled = np.flatnonzero(counts)
    anchors: list[np.ndarray | list[int]] = [[] for _ in texts]
    for low in range(0, len(filled), 128):
        some = filled[low : low + 128]
        for i, row in zip(some.tolist(), _anchors(sums[some])):
            anchors[i] = row
    return pa.StructArray.from_arrays(
        [
            pa.array(keys),
            pa.array(counts),
            pa.array(anchors, pa.list_(pa.int16())),
            pa.array(list(sketches), pa.list_(pa.int64())),
        ],
        names=["key", "n", "anchors", "sketch"],
    )


@F.arrow_udf(_SIGNATURE)
def signature(texts: pa.Array) -> pa.Array:
    """The hash of the text's shingle set, its size, its anchors and its fingerprint."""
    parts = [_signatures(part) for part in slices(texts, 1_000_000)]
    return pa.concat_arrays(parts) if parts else pa.array([], _ARROW)


def _likely(a: Column, b: Column, fewer: Column) -> Column:
    """Whether two fingerprints agree in enough bits for their texts to be compared; ``fewer``: the smaller set's size."""
    differ = F.lit(0)
    for k in range(LONGS):
        differ = differ + F.bit_count(a[k].bitwiseXOR(b[k]))
    return differ <= F.when(fewer < FEW, MOST_DIFFER_FEW).otherwise(MOST_DIFFER)


@F.arrow_udf(BooleanType())
def _near(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether two texts are near copies, by their shingles themselves."""
    out = []
    last, held = None, set()
    for x, y in zip(a.cast(pa.large_binary()), b.cast(pa.large_binary())):
        if (text := y.as_py()) != last:
            last, held = text, shingle_set(text)
        grams = shingle_set(x.as_py())
        both = len(grams & held)
        out.append(OUT_OF * both >= SIMILAR * (len(grams) + len(held) - both))
    return pa.array(out, pa.bool_())


def _row_key(id_col: Column, text: Column) -> Column:
    return F.xxhash64(id_col.cast("string"), text)


def _compared(pairs: DataFrame, points: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (a, b, near) of the pairs (a, b) whose sketches agree well enough; stored."""
    side = points.select("key", "rid", "n", "sketch")
    x, y = (side.select(*[F.col(c).alias(f"{c}_{s}") for c in side.columns]) for s in "ab")
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    likely = stored(
        pairs.join(x, F.col("a") == F.col("key_a"))
        .join(y, F.col("b") == F.col("key_b"))
        .filter(OUT_OF * small >= SIMILAR * large)
        .filter(_likely(F.col("sketch_a"), F.col("sketch_b"), small))
        .select("a", "b", "rid_a", "rid_b"),
        "likely-pairs",
    )
    asked = likely.select(F.col("rid_a").alias("rid")).unionByName(likely.select(F.col("rid_b").alias("rid"))).distinct()
    read = stored(texts.join(asked, "rid").dropDuplicates(["rid"]), "pair-texts")
    first = read.select(F.col("rid").alias("rid_a"), F.col("text").alias("text_a"))
    second = read.select(F.col("rid").alias("rid_b"), F.col("text").alias("text_b"))
    return stored(
        likely.join(first, "rid_a").join(second, "rid_b").select("a", "b", _near("text_a", "text_b").alias("near")),
        "compared",
    )


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


@F.arrow_udf(BinaryType())
def _shingle_hashes(texts: pa.Array) -> pa.Array:
    return pa.array([_hashes(t.as_py()).tobytes() for t in texts.cast(pa.large_binary())], pa.binary())


def _links_of_unit(unit: pa.Table) -> list[tuple[int, int]]:
    """Links that connect what near pairs of the unit's texts connect; texts of one group are connected already."""
    keys, blocks, n = (unit[c].to_numpy() for c in ("key", "block", "n"))
    sketches = unit["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, LONGS)
    # all in one block, or two blocks of which only pairs across are asked for
    inside = unit["low"][0].as_py() == unit["high"][0].as_py()
    start = np.unique(unit["group"].to_numpy(), return_inverse=True)[1].tolist()
    root = list(range(max(start) + 1))
    sets: dict[int, set[int]] = {}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def grams(i: int) -> set[int]:
        if i not in sets:
            sets[i] = set(np.frombuffer(unit["shingles"][i].as_py(), np.uint64).tolist())
        return sets[i]

    found = []
    for i in range(len(keys) - 1):
        small, large = np.minimum(n[i], n[i + 1 :]), np.maximum(n[i], n[i + 1 :])
        differ = np.bitwise_count(sketches[i + 1 :] ^ sketches[i]).sum(axis=1, dtype=np.int64)
        likely = (differ <= np.where(small < FEW, MOST_DIFFER_FEW, MOST_DIFFER)) & (OUT_OF * small >= SIMILAR * large)
        if not inside:
            likely &= blocks[i + 1 :] != blocks[i]
        for j in (np.flatnonzero(likely) + i + 1).tolist():
            a, b = find(start[i]), find(start[j])
            if a != b:
                x, y = grams(i), grams(j)
                both = len(x & y)
                if OUT_OF * both >= SIMILAR * (len(x) + len(y) - both):
                    root[a] = b
                    found.append((int(keys[i]), int(keys[j])))
    return found


def _near_in_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each unit of rows that come sorted by unit; a unit may cross batches."""

    def linked(units: list[pa.Table]) -> pa.RecordBatch:
        links = [link for unit in units for link in _links_of_unit(unit)]
        ends = np.array(links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(ends.max(axis=1, initial=-(1 << 63))), pa.array(ends.min(axis=1, initial=(1 << 63) - 1))],
            names=["a", "b"],
        )

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if table.num_rows:
            names = [table[c].to_numpy() for c in ("place", "low", "high")]
            new = np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in names])) + 1
            starts = np.r_[0, new].tolist()
            yield linked([table.slice(x, y - x) for x, y in zip(starts, starts[1:])])
            held = table.slice(starts[-1])
    if held is not None:
        yield linked([held])


def _meeting(places: DataFrame, parts: int | Column = 1) -> DataFrame:
    """Links (a, b) that connect what near pairs of different groups connect in each place.

    The texts of a place are dealt to ``parts`` blocks; each two of them, and each alone, are a unit of a task.
    """
    part = F.pmod(F.xxhash64("key"), F.lit(parts) if isinstance(parts, int) else parts)
    other = F.explode(F.sequence(F.lit(0).cast("long"), (F.lit(parts) if isinstance(parts, int) else parts).cast("long") - 1))
    units = (
        places.withColumn("block", part.cast("long"))
        .withColumn("other", other)
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
    )
    columns = ["place", "low", "high", "block", "key", "group", "n", "sketch", "shingles"]
    number = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        units.select(*columns)
        .repartition(number, "place", "low", "high")
        .sortWithinPartitions("place", "low", "high")
        .mapInArrow(_near_in_units, "a bigint, b bigint")
    )


def _inside(active: DataFrame, points: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) of near copies of different groups that share a band; stored.

    The two texts of a band that has no more have met already, as one of them was its leader.
    """
    sizes = active.groupBy("band").agg(F.count("*").alias("size")).where(F.col("size") > (2 if ROUNDS else 1))
    sized = stored(active.join(sizes, "band").withColumnRenamed("band", "place"), "places")
    asked = sized.select("key").distinct().join(points.select("key", "rid", "n", "sketch"), "key")
    held = stored(
        texts.join(asked, "rid").dropDuplicates(["rid"]).select("key", "n", "sketch", _shingle_hashes("text").alias("shingles")),
        "place-texts",
    )
    places = sized.join(held, "key")
    few = _meeting(places.where(F.col("size") <= CROWDED))
    many = _meeting(places.where(F.col("size") > CROWDED), F.ceil(F.col("size") / CROWDED))
    return stored(few.unionByName(many).distinct(), "place-links")


def _links(points: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect all points that near pairs connect."""
    number = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt once: the shared bands are found, and their members picked, where the rows are
    members = _members(points).repartition(number, "band")
    shared = members.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    active = stored(
        members.join(shared.filter("low <> high").select("band"), "band").withColumn("group", F.col("key")), "bands"
    )
    tested = links = None
    for number in range(ROUNDS):
        if active.isEmpty():
            break
        ranked = active.withColumn("degree", F.lit(0).cast("long"))
        if links is not None:
            ends = links.select(F.explode(F.array("a", "b")).alias("key"))
            degrees = ends.groupBy("key").agg(F.count("*").alias("degree"))
            ranked = active.join(degrees, "key", "left").fillna(0, ["degree"])
        leaders = ranked.groupBy("band").agg(F.max(F.struct("degree", "key", "group")).alias("leader"))
        apart = active.join(leaders, "band").filter(F.col("group") != F.col("leader.group"))
        pairs = apart.select(*_pair(F.col("key"), F.col("leader.key"))).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        found = _compared(pairs, points, texts)
        tested = found if tested is None else tested.unionByName(found)
        links = tested.filter("near").select("a", "b")
        # Bands whose texts are joined already are done.
        named = components(links).withColumnRenamed("node", "key")
        grouped = active.drop("group").join(named, "key", "left")
        grouped = grouped.select("band", "key", F.coalesce("component", "key").alias("group"))
        open_bands = grouped.groupBy("band").agg(F.min("group").alias("low"), F.max("group").alias("high"))
        active = stored(grouped.join(open_bands.filter("low <> high").select("band"), "band"), "bands")
    if not active.isEmpty():
        found = _inside(active, points, texts)
        links = found if links is None else links.unionByName(found)
    return links if links is not None else points.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id and ``component_id``, the smallest id that near copies reach.

    Texts with equal shingle sets (exact copies among them, and all texts without words) are one point from
    the start. Ids may repeat or be null, as in ``simhash.near_duplicates``.
    """
    named = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")).alias("text"))
    rows = stored(
        named.select("id", _row_key(F.col("id"), F.col("text")).alias("rid"), signature("text").alias("s")).select(
            "id", "rid", "s.*"
        ),
        "signatures",
    )
    points = stored(
        rows.groupBy("key").agg(
            F.min("id").alias("first"),
            F.min("rid").alias("rid"),
            F.first("n").alias("n"),
            F.first("anchors").alias("anchors"),
            F.first("sketch").alias("sketch"),
        ),
        "points",
    )
    texts = named.select(_row_key(F.col("id"), F.col("text")).alias("rid"), "text")
    joined = components(_links(points, texts))
    grouped = points.join(joined, points["key"] == joined["node"], "left").select(
        "key", "first", F.coalesce("component", "key").alias("group")
    )
    least = grouped.groupBy("group").agg(F.min("first").alias("component_id"))
    found = grouped.join(least, "group").select("key", "component_id")
    return rows.select("id", "key").join(found, "key").select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each group of near copies, with all its columns."""
    return kept_rows(docs, near_copies(docs, id_col, text_col), id_col)
