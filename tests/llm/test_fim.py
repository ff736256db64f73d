"""Fill-in-the-middle against a plain implementation by regular expression."""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(key, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rnd = random.Random(13)
    bits = ["a", "b", "né", "日本", "😀", "word", " ", "  ", "\n", "\t\r", "\x0b", "\xa0", "<", "<P", "S>", "\x00"]
    out = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 400))) for _ in range(150)]
    out += [" ".join(rnd.choice(bits) for _ in range(rnd.randint(1, 20_000))) for _ in range(12)]
    out += [None, "", " ", " \n ", "one", " one", "one ", "x" * 100_000, "é" * 40_000, " " * 50_000]
    out += ["has <P> inside", "<M>", "é" * 20_000 + " " + "日" * 30_000 + " end"]
    out += [out[5], out[5], out[155], "prefix " + out[155]]
    return out


@pytest.mark.parametrize("zero_bits, max_chunk", [(10, 16_384), (2, 64), (20, 7)])
def test_chunks_give_the_units_of_the_whole(monkeypatch, zero_bits, max_chunk):
    monkeypatch.setattr(fim, "ZERO_BITS", zero_bits)
    monkeypatch.setattr(fim, "MAX_CHUNK", max_chunk)
    cache = fim.ContentCache(20_000)
    some = [(t or "").encode() for t in texts()]
    for data, ends in zip(some, fim.chunk_ends(some)):
        assert (ends == [] if not data else ends[-1] == len(data)) and ends == sorted(set(ends))
        assert b"".join(data[a:b] for a, b in zip([0, *ends], ends)) == data
        whole, units = fim.Text(data, ends, cache), UNIT.findall(data.decode())
        assert (whole.units, whole.chars) == (len(units), len(data.decode()))
        for k in {0, 1, 2, len(units) // 3, len(units) // 2, len(units) - 1, len(units)} - {-1}:
            head = "".join(units[:k])
            assert whole.cut(k) == (len(head.encode()), len(head))
    assert cache.size == sum(len(c) for c, _ in cache.held.values())
    assert cache.size <= 20_000 or len(cache.held) == 1


def test_shared_passages_are_summarised_once():
    rnd = random.Random(3)
    shared = " ".join(f"w{rnd.randint(0, 999)}" for _ in range(20_000)).encode()
    heads = [b"", b"one ", b"some other words "]
    some = [h + shared for h in heads]
    cache = fim.ContentCache()
    for data, ends in zip(some, fim.chunk_ends(some)):
        fim.Text(data, ends, cache)
    assert cache.misses <= len(fim.chunk_ends([shared])[0]) + 2 * len(heads)
    assert cache.hits >= 2 * len(fim.chunk_ends([shared])[0]) - 2 * len(heads)


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr("builtins.hash", lambda x: 1)
    cache = fim.ContentCache()
    assert cache.summary(b"a b c").words == 3 and cache.summary(b"abc").words == 1
    assert cache.summary(b"a b c").words == 3 and cache.hits == 0


def test_columns_match_and_come_back(make_docs):
    rows = [*enumerate(texts()), (None, "some words of a row without a key"), (7, "other words"), (7, None)]
    docs = make_docs(rows)
    found = docs.select("doc_id", "text", fim.transform(F.col("text"), F.col("doc_id")).alias("f"))
    got = found.select("*", fim.restore(F.col("f.output"), F.col("f.form")).alias("back")).collect()
    assert len(got) == len(rows)
    forms = set()
    for r in got:
        assert tuple(r["f"]) == plainly(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
        forms.add(r["f"]["form"])
    assert forms == {"plain", "spm", "psm"}
    assert docs.limit(0).select(fim.transform(F.col("text"), F.col("doc_id"))).count() == 0


def test_a_worker_hashes_bounded_parts_of_a_batch(monkeypatch):
    """However large an Arrow batch is, the arrays of the rolling hash are small."""
    kept, sizes = {}, []
    real = fim.chunk_ends

    def counted(some):
        sizes.append(sum(map(len, some)))
        return real(some)

    monkeypatch.setattr(fim.F, "arrow_udf", lambda kind: lambda f: kept.setdefault("f", f) and (lambda *a: None))
    monkeypatch.setattr(fim, "draws", lambda key, seed: [None] * 4)
    monkeypatch.setattr(fim, "chunk_ends", counted)
    fim.transform(None, None)
    rnd = random.Random(4)
    some = [" ".join(f"w{rnd.randint(0, 999)}" for _ in range(10_000)) for _ in range(60)]
    numbers = pa.array([7] * len(some))
    out = kept["f"](pa.array(some), numbers, numbers, numbers, numbers)
    assert out.field("n").to_pylist() == [10_000] * len(some)
    assert sum(sizes) == sum(map(len, some)) > 2_500_000 and max(sizes) <= 600_000
    assert fim.CACHE_BYTES <= 8_000_000
