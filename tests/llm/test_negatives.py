"""Hard negatives against brute force, and the bounds that spare scores."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import negatives


def brute(rows, positives=5, k=3, low=50, high=95):
    """Result rows of ``rows`` (id, label, vector); anchors are ids divisible by 5."""
    fine = [
        (i, label, [math.floor(256 * x) for x in v])
        for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (i, label, v) in enumerate(fine):
        if i % 5:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, lab == label) for b, (j, lab, w) in enumerate(fine) if b != a)
        for minus, j, _ in [s for s in scored if s[2]][:positives]:
            inside = [s for s in scored if not s[2] and low * -minus <= 100 * -s[0] <= high * -minus][:k]
            out += [(i, j, n + 1, s[1], -minus, -s[0]) for n, s in enumerate(inside)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(
        [(i, label, v, 0, 1) for i, label, v in rows], "vec_id long, label int, embedding array<float>, row int, n int"
    )
    found = negatives.mine(df, F.col("vec_id"), F.col("label"), F.col("embedding"), F.col("id") % 5 == 0, **kw)
    return sorted(tuple(r) for r in found.collect())


def vectors(n, width, seed, spread=0.05):
    """Clustered float vectors, as single precision holds them."""
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(0, 0.3, (6, width))
    return (centres[rnd.integers(0, 6, n)] + rnd.normal(0, spread, (n, width))).astype(np.float32).astype(float).tolist()


@pytest.mark.parametrize("block, anchor, stripe", [(2048, 1024, 32), (40, 9, 1)])
def test_as_brute_force(spark, monkeypatch, block, anchor, stripe):
    for name, value in (("BLOCK_ROWS", block), ("ANCHOR_ROWS", anchor), ("STRIPE_BLOCKS", stripe), ("OPEN_BLOCKS", 1)):
        monkeypatch.setattr(negatives, name, value)
    rnd = random.Random(block)
    rows = [(i, rnd.choice([0, 1, 1, 2]), v) for i, v in enumerate(vectors(150, 8, 1))]
    # Copies, ties, repeated rows, other lengths, and what takes no part.
    rows += [(200 + i, rnd.choice([0, 1]), rows[3][2]) for i in range(40)]
    rows += [rows[0], rows[5], rows[5], (5, 0, rows[7][2])]
    rows += [(300, 1, [0.5] * 3), (305, 1, []), (310, 2, [0.25] * 12), (315, 9, rows[1][2])]
    rows += [(None, 1, rows[0][2]), (400, None, rows[0][2]), (405, 1, None), (410, 1, [None] * 8)]
    rows += [(415, 1, [math.nan] * 8), (420, 1, [math.inf] + [0.0] * 7)]
    rnd.shuffle(rows)
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows) == want
    assert mined(spark, rows, positives=2, negatives=1, low=20, high=100) == brute(rows, 2, 1, 20, 100)


def test_large_numbers_stay_exact(spark):
    rnd = random.Random(4)
    rows = [(i, i % 2, [float(np.float32(rnd.uniform(1e5, 2e5))) for _ in range(6)]) for i in range(30)]
    rows = [(i, label, v) for i, label, v in rows]
    assert mined(spark, rows) == brute(rows)


def test_scores_beyond_64_bits_fail(spark):
    with pytest.raises(Exception, match="64-bit"):
        mined(spark, [(0, 0, [1e12]), (5, 0, [1e12])])


def test_empty_table_and_no_anchor(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 0, [1.0]), (2, 1, [1.0])]) == []


def test_the_tree_is_minimal_and_its_bounds_spare_scores():
    points = np.array(vectors(120, 8, 2, 0.01))
    order, parent, edge = negatives.spanning_tree(points)
    assert sorted(order.tolist()) == list(range(120)) and parent[order[0]] == order[0]
    place = {k: n for n, k in enumerate(order.tolist())}
    assert all(place[int(p)] <= place[k] for k, p in enumerate(parent))
    full = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    inside, total = [int(order[0])], 0.0  # Prim on the full matrix
    while len(inside) < 120:
        rest = [k for k in range(120) if k not in inside]
        part = full[np.ix_(inside, rest)]
        total += part.min()
        inside.append(rest[int(part.min(axis=0).argmin())])
    assert edge.sum() == pytest.approx(total)

    def block(kind, array, **more):
        numbers = np.floor(256 * array).astype(np.int64)
        ids = np.arange(len(array), dtype=np.int64)
        return kind({"n": len(array), "width": 8, "numbers": numbers.tobytes(), **{c: ids.tobytes() for c in ("rows", "ids", "labels")}, **more})

    candidates = np.array(vectors(2000, 8, 3, 0.01))
    grown = negatives.spanning_tree(np.floor(256 * points))
    tree = block(negatives.Tree, points, block=0, **dict(zip(("tree", "parent", "edge"), (x.tobytes() for x in grown))))
    scores = np.floor(256 * points).astype(int) @ np.floor(256 * candidates).astype(int).T
    cut = np.quantile(scores, 0.99)
    seen = set()
    scored = negatives.walk(
        tree,
        block(negatives.Block, candidates),
        lambda k: (cut, math.inf),
        lambda k: np.ones(2000, bool),
        lambda k, hit, found: [seen.add((k, int(h), int(s))) for h, s in zip(hit, found)],
    )
    want = {(k, c, int(scores[k, c])) for k, c in zip(*np.nonzero(scores >= cut))}
    assert want <= seen and scored == len(seen) < 0.5 * scores.size
