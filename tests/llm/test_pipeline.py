"""The pipeline on a small corpus in which each stage has one thing to do."""

from __future__ import annotations

import hashlib
import random

import pytest

import corpus_pipeline

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_each_stage_does_its_part(spark, tmp_path):
    from tokenizers import Tokenizer

    rnd = random.Random(3)

    def prose(n):
        return " ".join(f"{rnd.choice('alpha beta gamma delta'.split())}{rnd.randint(0, 5000)}" for _ in range(n))

    texts = {i: prose(rnd.randint(60, 120)) for i in range(80)}
    junk = {i: " ".join(w[:-1] + "##" for w in prose(rnd.randint(60, 120)).split()) for i in range(100, 140)}
    line = "A line that many documents hold"
    for i in (1, 2, 3):
        texts[i] += "\n" + line
    item = prose(30)
    texts[10] = f"{prose(50)} {item} {prose(50)}"
    texts[90] = texts[20]  # an exact copy: the smaller id stays
    docs = [(i, t, "en", "s", len(t)) for i, t in {**texts, **junk}.items()]
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(i, int(i in texts), 0) for i, *_ in docs], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, item)], "item_id long, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for i in (1, 2):
        texts[i] = texts[i].removesuffix("\n" + line)
    del texts[10], texts[90]
    codec = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in texts.items():
        ids = codec.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want
    assert len(got) == len(want)
