"""Near copies of the pipeline: edited copies go, texts below the similarity stay."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from seqloom.llm import nearcopies


def jaccard(a, b):
    x, y = (nearcopies.shingle_set((t or "").encode()) for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def test_edited_copies_match_brute_force(spark, make_docs):
    rnd = random.Random(12)

    def prose(n):
        return [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]

    def edited(words, edits):
        out = list(words)
        for at in rnd.sample(range(len(out)), edits):
            out[at] = "Edited%d" % rnd.randint(0, 10**6)
        return out

    bases = [prose(rnd.choice([3, 6, 40, 120, 400, 900])) for _ in range(40)]
    texts = [" ".join(b) for b in bases]
    for base in bases:
        for edits in (1, 2, 3, 5, 8):
            if edits < len(base):
                texts.append(" ".join(edited(base, edits)))
    # One text with many copies, each edited in places of its own: most are near to the text alone.
    star = prose(200)
    texts += [" ".join(edited(star, 4)) for _ in range(60)] + [" ".join(star)]
    texts += [None, "", " \n", texts[3], texts[3].upper()]
    rnd.shuffle(texts)
    rows = list(enumerate(texts)) + [(None, texts[0]), (5, texts[9])]
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                root[find(i)] = find(j)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    docs = make_docs(rows)
    got = nearcopies.near_copies(docs).collect()
    want = sorted((str(i), str(least.get(find(n)))) for n, (i, _) in enumerate(rows))
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == want
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(least.values())) and ids.count(None) == 1
    assert len(set(least.values())) < len(rows) - 150
    assert nearcopies.near_copies(docs.limit(0)).count() == 0


def test_a_group_that_one_leader_does_not_join_is_whole(spark, make_docs, monkeypatch):
    monkeypatch.setattr(nearcopies, "ROUNDS", 1)
    rnd = random.Random(5)
    chain = [[f"w{i}" for i in range(300)]]
    for step in range(25):
        chain.append([f"s{step}x{i}" if step * 12 <= i < step * 12 + 12 else w for i, w in enumerate(chain[-1])])
    rows = list(enumerate(" ".join(c) for c in chain))
    rnd.shuffle(rows)
    assert {r["component_id"] for r in nearcopies.near_copies(make_docs(rows)).collect()} == {0}


def test_texts_that_share_a_passage_and_are_not_near(spark, make_docs, monkeypatch):
    """Crowded bands are refined; every near pair is found, and few others become rows."""
    monkeypatch.setattr(nearcopies, "CROWDED", 4)
    rnd = random.Random(21)
    passage = [f"p{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = [f"o{i}x{k}" for k in range(rnd.randint(40, 70))]
        rows.append(own[:20] + passage + own[20:])
    for i in rnd.sample(range(150), 12):  # and a few near copies of such texts
        copy = list(rows[i])
        copy[rnd.randrange(len(copy))] = "edited"
        rows.append(copy)
    texts = [" ".join(r) for r in rows]
    want = set()
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                want.add((i, j))
    assert len(want) == 12
    met = []
    real = nearcopies._meeting

    def counted(places, parts=1):
        found = real(places, parts)
        met.append(found.count())
        return found

    monkeypatch.setattr(nearcopies, "_meeting", counted)
    found = nearcopies.near_copies(make_docs(list(enumerate(texts)))).collect()
    joined = {(r["doc_id"], r["component_id"]) for r in found if r["doc_id"] != r["component_id"]}
    assert joined == want
    assert len(met) > 1 and sum(met) < 0.2 * 150 * 149 / 2


def test_an_anchor_is_the_nearest_word_of_the_code():
    """Every string of 256 bits is within 120 bits of its anchor, a word of the first-order Reed-Muller code."""
    length = nearcopies.LENGTH
    words = np.array([[(i & k).bit_count() & 1 for k in range(length)] for i in range(length)])
    signs = 1 - 2 * words  # and their complements
    sums = np.random.default_rng(3).choice([-1, 1], (40, nearcopies.BITS)).astype(np.int32)
    anchors = nearcopies._anchors(sums)
    assert anchors.shape == (40, nearcopies.BLOCKS)
    for block in (0, 7, 95):
        seen = sums[:, nearcopies._TAKEN[block]] * nearcopies._SIGNS[block][:, 0].astype(int)
        anchor = anchors[:, block]
        agreement = seen @ signs.T
        assert (np.abs(agreement).max(axis=1) == np.abs(agreement[range(40), anchor >> 1])).all()
        assert ((agreement[range(40), anchor >> 1] < 0) == anchor % 2).all()
        assert ((length - np.abs(agreement).max(axis=1)) / 2 <= 120).all()


def test_a_crowd_just_below_the_similarity_makes_few_rows(spark, make_docs, monkeypatch):
    """Pairs of a crowd are compared inside tasks: rows follow the texts, links of near pairs all count."""
    monkeypatch.setattr(nearcopies, "CROWDED", 16)
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(160):
        own = list(base)
        for at in rnd.sample(range(2, 148, 5), rnd.choice([2, 3, 4])):
            own[at] = f"o{i}x{at}"
        rows.append(own)
    texts = [" ".join(r) for r in rows]
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    near = likely = 0
    for i in range(len(texts)):
        for j in range(i):
            similar = jaccard(texts[i], texts[j])
            likely += similar >= 0.7
            near += similar >= 0.8
            if similar >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert near > 200 and likely - near > 3000
    met, compared = [], []
    real, real_compared = nearcopies._meeting, nearcopies._compared
    monkeypatch.setattr(nearcopies, "_meeting", lambda *a: met.append((found := real(*a)).count()) or found)
    monkeypatch.setattr(
        nearcopies, "_compared", lambda *a: compared.append((found := real_compared(*a)).count()) or found
    )
    found = nearcopies.near_copies(make_docs(list(enumerate(texts)))).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(i, find(i)) for i in range(len(texts))]
    assert sum(met) < nearcopies.BLOCKS * len(texts) / 4 and sum(compared) < likely
