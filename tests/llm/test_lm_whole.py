"""The language model keeps every n-gram, and its size follows the input."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pytest

from seqloom.llm import lm


@pytest.mark.parametrize("segment_bytes", [1 << 24, 100])
def test_pairs_seen_once_count(make_docs, monkeypatch, segment_bytes):
    monkeypatch.setattr(lm, "SEGMENT_BYTES", segment_bytes)
    rnd = random.Random(9)
    rows = [(i, " ".join(f"w{rnd.randint(0, 3000)}" for _ in range(rnd.randint(1, 40)))) for i in range(150)]
    train = [t.split() for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    tokens, pairs = Counter(), Counter()
    for words in train:
        words = [*words, None]
        tokens.update(words)
        pairs.update(zip([None, *words], words))
    total, distinct = sum(tokens.values()), len(tokens)

    def read(n):
        """The count as the levels of the filter give it back."""
        if n < 2:
            return float(n)
        return lm.STEP ** (math.floor(math.log(n) / math.log(lm.STEP) + 1e-9) + 0.5)

    def score(text):
        words, out = [*text.split(), None], 0.0
        for v, x in zip([None, *words], words):
            p = (read(tokens[x]) + lm.ALPHA) / (total + lm.ALPHA * (distinct + 1))
            c = read(pairs[v, x])
            share = min(1.0, c / max(read(tokens[v]), c, 1.0))
            out += math.log10(lm.PAIR_WEIGHT * share + (1 - lm.PAIR_WEIGHT) * p)
        return out

    got = {r["doc_id"]: r["score"] for r in lm.score_documents(make_docs(rows)).collect()}
    # False positives of the filter raise a count now and then.
    errors = [abs(got[i] - score(t)) / (t.count(" ") + 2) for i, t in rows]
    assert sorted(errors)[len(errors) // 2] < 0.01 and max(errors) < 0.5
