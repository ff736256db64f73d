"""Hard negatives by bounds along a spanning tree of the anchors.

Anchors are packed into blocks, and within each block joined by a minimum spanning tree. A candidate's
score at an anchor lies within its score at the parent plus or minus edge length times the candidate's
norm (Cauchy and Schwarz), so down the tree every candidate has an interval. Only candidates whose
interval meets the anchor's window are scored, exactly and in integers, which makes their interval a
point again; the others pass their interval on, wider by the edge.

Two passes use the walk. The first finds the positives: its window runs from the last of the best
scores so far to infinity. The second takes the window that the positives set, whose lower end rises
with the negatives found. Candidates lie in blocks, a bounded number of blocks to a stripe; the anchor
blocks, the query set, go to every stripe. Tasks give out the best rows for each anchor and stripe,
which are merged by a grouping on the anchor. No step holds all anchors or all candidates.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.skew import work_partitions
from seqloom.session import stored

#: Rows and numbers that a block of candidates, and one of anchors, holds at most.
BLOCK_ROWS, ANCHOR_ROWS = 2048, 1024
BLOCK_NUMBERS = 1 << 18
#: Candidate blocks in a stripe, about.
STRIPE_BLOCKS = 32
#: Anchor blocks whose best rows a task keeps before it gives them out.
OPEN_BLOCKS = 32

_BLOCK_DDL = "stripe int, n int, width int, rows binary, ids binary, labels binary, numbers binary"
_BLOCK_SCHEMA = pa.schema(
    [("stripe", pa.int32()), ("n", pa.int32()), ("width", pa.int32())]
    + [(c, pa.binary()) for c in ("rows", "ids", "labels", "numbers")]
)


def usable(rows: DataFrame, row_id: Column, label: Column, vector: Column, scale: int = 256) -> DataFrame:
    """The rows that take part, as ``row, id, label, numbers``, stored. ``numbers`` are floor(scale * x).

    Rows without id or label, without vector, or with a null or non-finite component do not.
    Repeated rows are rows of their own, told apart by ``row``. An empty vector scores 0 with all.
    """
    fine = F.forall(F.col("vector"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf))
    return stored(
        rows.select(row_id.cast("long").alias("id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("vector"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & fine)
        .select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            "label",
            F.transform("vector", lambda x: F.floor(x * scale).cast("long")).alias("numbers"),
        ),
        "negatives-rows",
    )


def _packed(rows: DataFrame, most_rows: int) -> DataFrame:
    """Rows packed into blocks, in their order; shorter vectors are padded with zeros.

    ``stripe`` is the number of the partition that a block comes from.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        width = 0
        stripe = TaskContext.get().partitionId()

        def block():
            matrix = np.zeros((len(held), width), np.int64)
            for k, (*_, numbers) in enumerate(held):
                matrix[k, : len(numbers)] = numbers
            plain = [np.array([h[c] for h in held], np.int64).tobytes() for c in range(3)]
            data = [[stripe], [len(held)], [width], *[[p] for p in plain], [matrix.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(d, f.type) for d, f in zip(data, _BLOCK_SCHEMA)], schema=_BLOCK_SCHEMA)

        for batch in batches:
            plain = [batch.column(c).to_pylist() for c in range(3)]
            for row, name, label, numbers in zip(*plain, batch.column(3)):
                numbers = numbers.values.to_numpy()
                wider = max(width, len(numbers))
                if held and (len(held) >= most_rows or (len(held) + 1) * wider > BLOCK_NUMBERS):
                    yield block()
                    held, wider = [], len(numbers)
                held.append((row, name, label, numbers))
                width = wider
        if held:
            yield block()

    return rows.select("row", "id", "label", "numbers").mapInArrow(pack, _BLOCK_DDL)


def candidate_blocks(rows: DataFrame) -> DataFrame:
    """All rows in blocks, stored."""
    stripes = math.ceil(rows.count() / (BLOCK_ROWS * STRIPE_BLOCKS))
    n = max(stripes, work_partitions(rows))
    return stored(_packed(rows.repartition(n, "row"), BLOCK_ROWS), "negatives-candidates")


def anchor_blocks(anchors: DataFrame) -> DataFrame:
    """Anchors in blocks, those of a label side by side, each block with its tree, stored."""
    n = max(1, math.ceil(anchors.count() / ANCHOR_ROWS))
    sorted_rows = anchors.repartitionByRange(n, "label", "row").sortWithinPartitions("label", "row")
    packed = _packed(sorted_rows, ANCHOR_ROWS).drop("stripe")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                order, parent, edge = spanning_tree(Block(one.to_pylist()[0]).floats)
                extra = [pa.array([x.tobytes()], pa.binary()) for x in (order, parent, edge)]
                yield pa.RecordBatch.from_arrays([*one.columns, *extra], names=[*one.schema.names, "tree", "parent", "edge"])

    ddl = _BLOCK_DDL.split(", ", 1)[1] + ", tree binary, parent binary, edge binary"
    return stored(packed.mapInArrow(grow, ddl).withColumn("block", F.monotonically_increasing_id()), "negatives-anchors")


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree by growth from the point nearest to the mean.

    Returns the points in an order in which parents come first, each point's parent (the root's is
    itself) and the length of the edge to it.
    """
    n = len(points)
    norms = (points * points).sum(axis=1)
    root = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
    order, parent, edge = np.zeros(n, np.int64), np.full(n, root), np.zeros(n)
    nearest = np.full(n, np.inf)
    nearest[root] = 0.0
    outside = np.ones(n, bool)
    for k in range(n):
        at = int(np.argmin(np.where(outside, nearest, np.inf)))
        if not outside[at]:  # distances beyond the range of doubles
            at = int(np.flatnonzero(outside)[0])
        order[k], outside[at] = at, False
        distance = np.maximum(norms + norms[at] - 2 * (points @ points[at]), 0.0)
        closer = outside & (distance < nearest)
        nearest[closer], parent[closer] = distance[closer], at
    # Taken from the difference: the expansion above loses digits where points are close.
    edge[:] = np.sqrt(((points - points[parent]) ** 2).sum(axis=1))
    return order, parent.astype(np.int64), edge


class Block:
    """One packed block as arrays."""

    def __init__(self, row: dict):
        self.n, self.width = row["n"], row["width"]
        self.rows, self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids", "labels"))
        self.numbers = np.frombuffer(row["numbers"], np.int64).reshape(self.n, self.width)
        self.floats = self.numbers.astype(np.float64)
        self.norms = np.sqrt((self.floats * self.floats).sum(axis=1))
        self.largest = int(np.abs(self.numbers).max(initial=0))


class Tree(Block):
    """A block of anchors with its spanning tree."""

    def __init__(self, row: dict):
        super().__init__(row)
        self.block = row["block"]
        self.order, self.parent = (np.frombuffer(row[c], np.int64).tolist() for c in ("tree", "parent"))
        self.edge = np.frombuffer(row["edge"], np.float64)


def walk(
    tree: Tree,
    candidates: Block,
    window: Callable[[int], tuple[float, float] | None],
    eligible: Callable[[int], np.ndarray],
    visit: Callable[[int, np.ndarray, np.ndarray], None],
) -> int:
    """Visit each anchor with its window-overlapping candidates and their exact scores.

    ``window(k)`` gives the least and greatest score wanted at anchor k, or None for none at all;
    ``eligible(k)`` says which candidates may count. Candidates outside the window may be visited too:
    overlap is decided on intervals. Returns how many candidates were scored.
    """
    width = min(tree.width, candidates.width)
    limit = tree.largest * candidates.largest * width
    if limit >= 1 << 63:
        raise ArithmeticError("scores exceed 64-bit integers")
    exact = limit < 1 << 53  # then float products and their sums are integers without loss
    x = (candidates.floats if exact else candidates.numbers)[:, :width]
    v = (tree.floats if exact else tree.numbers)[:, :width]
    children = np.bincount(np.array(tree.parent), minlength=tree.n)
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    scored = 0
    for k in tree.order:
        p = tree.parent[k]
        if p == k:
            every = (x @ v[k]).astype(np.float64)
            low, high = every.copy(), every.copy()
        else:
            # A unit, and a share far above rounding errors, on the safe side.
            reach = candidates.norms * tree.edge[k] + 1.0 + 1e-9 * candidates.norms * (tree.edge[k] + tree.norms[p])
            low, high = bounds[p][0] - reach, bounds[p][1] + reach
        children[p] -= 1
        if not children[p]:
            bounds.pop(p, None)
        wanted = window(k)
        if wanted is not None:
            hit = np.flatnonzero(eligible(k) & (high >= wanted[0]) & (low <= wanted[1]))
            if len(hit):
                scores = (x[hit] @ v[k]).astype(np.int64)
                scored += len(hit)
                low[hit] = high[hit] = scores
                visit(k, hit, scores)
        if children[k]:
            bounds[k] = low, high
    return scored


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties by smaller id."""
    if len(scores) > 4 * k:
        cut = -np.partition(-scores, k - 1)[k - 1]
        near = scores >= cut
        scores, ids = scores[near], ids[near]
    first = np.lexsort((ids, -scores))[:k]
    return scores[first], ids[first]


class Positives:
    """Best rows with the anchor's own label, for one anchor block."""

    def __init__(self, tree: Tree, k: int):
        self.tree, self.k = tree, k
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * tree.n

    def take(self, candidates: Block) -> None:
        tree = self.tree
        same = {label: candidates.labels == label for label in np.unique(tree.labels).tolist()}

        def window(k):
            scores = self.best[k][0]
            return (float(scores[-1]) if len(scores) == self.k else -math.inf), math.inf

        def visit(k, hit, scores):
            ids = candidates.ids[hit]
            other = candidates.rows[hit] != tree.rows[k]
            old = self.best[k]
            self.best[k] = _best(np.concatenate([old[0], scores[other]]), np.concatenate([old[1], ids[other]]), self.k)

        walk(tree, candidates, window, lambda k: same[int(tree.labels[k])], visit)

    def rows(self) -> Iterator[tuple]:
        for k, (scores, ids) in enumerate(self.best):
            for score, name in zip(scores.tolist(), ids.tolist()):
                yield self.tree.block, k, int(self.tree.ids[k]), name, score


class Negatives:
    """Best rows of other labels inside the window of each positive, for one anchor block."""

    def __init__(self, tree: Tree, positives: list, k: int, low: int, high: int):
        self.tree, self.k = tree, k
        none = np.zeros(0, np.int64)
        #: For each anchor: [positive's number, id, score, least, greatest, best scores, best ids]
        self.wanted: list[list[list]] = [[] for _ in range(tree.n)]
        for entry in positives:
            for n, p in enumerate(entry["positives"]):
                least, greatest = -((-low * p["score"]) // 100), high * p["score"] // 100
                if least <= greatest:
                    self.wanted[entry["anchor"]].append([n, p["id"], p["score"], least, greatest, none, none])

    def take(self, candidates: Block) -> None:
        tree = self.tree
        others = {label: candidates.labels != label for label in np.unique(tree.labels).tolist()}

        def window(k):
            if self.wanted[k]:
                return float(min(w[3] for w in self.wanted[k])), float(max(w[4] for w in self.wanted[k]))

        def visit(k, hit, scores):
            ids = candidates.ids[hit]
            for w in self.wanted[k]:
                inside = (scores >= w[3]) & (scores <= w[4])
                if inside.any():
                    w[5], w[6] = _best(np.concatenate([w[5], scores[inside]]), np.concatenate([w[6], ids[inside]]), self.k)
                    if len(w[5]) == self.k:
                        w[3] = int(w[5][-1])

        walk(tree, candidates, window, lambda k: others[int(tree.labels[k])], visit)

    def rows(self) -> Iterator[tuple]:
        for k, wanted in enumerate(self.wanted):
            for n, positive, positive_score, *_, scores, ids in wanted:
                for score, name in zip(scores.tolist(), ids.tolist()):
                    yield self.tree.block, k, int(self.tree.ids[k]), n, positive, positive_score, name, score


def _searched(
    candidates: DataFrame, anchors: DataFrame, begin: Callable[[dict], Positives | Negatives], ddl: str, fields: list[str]
) -> DataFrame:
    """The rows of ``begin(anchor block)`` after all candidates of a stripe, for each stripe."""
    schema = pa.schema([(f, pa.int64()) for f in fields])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task meets a stripe's pairs of blocks in any order; few anchor blocks are kept open.
        open_blocks: OrderedDict[int, Positives | Negatives] = OrderedDict()
        seen: tuple[bytes, Block] | None = None

        def given(done):
            rows = list(done.rows())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

        for batch in batches:
            for k in range(batch.num_rows):
                pair = batch.slice(k, 1).to_pylist()[0]
                query = pair.pop("query")
                if query["block"] not in open_blocks:
                    open_blocks[query["block"]] = begin(query)
                    if len(open_blocks) > OPEN_BLOCKS:
                        yield from given(open_blocks.popitem(last=False)[1])
                open_blocks.move_to_end(query["block"])
                if seen is None or seen[0] != pair["rows"]:
                    seen = pair["rows"], Block(pair)
                open_blocks[query["block"]].take(seen[1])
        for done in open_blocks.values():
            yield from given(done)

    stripes = (candidates.agg(F.max("stripe")).first()[0] or 0) + 1
    # Blocks are few and stand for much work, so the number of partitions is fixed on both sides.
    n = max(3 * stripes, work_partitions(candidates))
    queries = anchors.select(F.struct("*").alias("query"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("at"))
    pairs = queries.repartition(n, "at").join(candidates.repartition(n, "stripe"), F.col("at") == F.col("stripe"))
    return pairs.drop("at").mapInArrow(search, ddl)


def _first(column: str, k: int) -> Column:
    """The first k of (score, id) pairs gathered from the stripes: k from each at most."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id")))
    return F.transform(F.slice(order, 1, k), lambda x: F.struct(x["id"].alias("id"), (-x["minus"]).alias("score"))).alias(column)


def mine(
    rows: DataFrame,
    row_id: Column,
    label: Column,
    vector: Column,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
) -> DataFrame:
    """Hard negatives of all anchors: ``anchor_id, positive_id, rank, negative_id`` and both scores.

    The score of two rows is the integer inner product of floor(scale * x); higher comes first, ties by
    smaller id. An anchor's positives are its first other rows of the same label. For each positive
    the first rows of other labels are returned whose score is at least ``low`` and at most ``high``
    percent of the positive's. ``is_anchor`` is a condition on ``id``.

    Rows without id, label or vector, or with a null or non-finite component take no part; vectors of
    different lengths are padded with zeros; repeated rows count as often as they stand there, and each
    anchor row has its own results. A positive without negatives gives no row, as does an empty
    table. Scores beyond 64 bits fail the job.
    """
    table = usable(rows, row_id, label, vector, scale)
    candidates = candidate_blocks(table)
    anchors = anchor_blocks(table.where(is_anchor))
    k_positives, k_negatives = positives, negatives
    found = _searched(
        candidates,
        anchors,
        lambda query: Positives(Tree(query), k_positives),
        "block long, anchor long, anchor_id long, id long, score long",
        ["block", "anchor", "anchor_id", "id", "score"],
    )
    best = found.groupBy("block", "anchor").agg(_first("positives", positives))
    # At most ANCHOR_ROWS entries a block.
    windows = best.groupBy("block").agg(F.collect_list(F.struct("anchor", "positives")).alias("windows"))
    with_windows = stored(anchors.join(windows, "block"), "negatives-windows")
    key = ["block", "anchor", "anchor_id", "n", "positive_id", "positive_score"]
    hits = _searched(
        candidates,
        with_windows,
        lambda query: Negatives(Tree(query), query["windows"], k_negatives, low, high),
        "block long, anchor long, anchor_id long, n long, positive_id long, positive_score long, id long, score long",
        [*key, "id", "score"],
    )
    merged = hits.groupBy(*key).agg(_first("found", negatives))
    return merged.select("anchor_id", "positive_id", "positive_score", F.posexplode("found").alias("at", "negative")).select(
        "anchor_id",
        "positive_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("negative.id").alias("negative_id"),
        "positive_score",
        F.col("negative.score").alias("negative_score"),
    )
