"""WARC archives: exact round trip, copies as revisits, foreign and damaged archives."""

from __future__ import annotations

import base64
import glob
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from seqloom.llm import warc


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def payloads():
    rnd = random.Random(12)
    bits = ["a", "é", "\r", "\n", "\r\n", "\r\r\n", "\n\r", "0\r\n\r\n", "WARC/1.1\r\n", "日本", "\x00", " "]
    out = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 200))) for _ in range(60)]
    out += [None, "", "\r\n", "\r", "x" * 64, "x" * 63, "x" * 65, "y" * 640, "\r\n" * 64, "é" * 5000]
    return out + [out[3], out[3], out[62], out[69]]


def expected(rows, min_bytes=0):
    """(id, bytes, digest, type, refers_to) of each row."""
    groups = {}
    for i, text in rows:
        groups.setdefault((text or "").encode(), []).append(i)
    out = []
    for data, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        for n, i in enumerate(ids):
            copy = n > 0 and len(data) >= min_bytes
            out.append((i, len(data), b32(data), "revisit" if copy else "response", ids[0] if copy else None))
    return sorted(out, key=repr)


def pages(spark, rows):
    return spark.createDataFrame(
        [(i, f"http://h/{n}\r\nX: {n}" if n % 3 else None, t, "x", n) for n, (i, t) in enumerate(rows)],
        "page_id long, url string, html string, data string, row int",
    )


def resolved(records):
    found = warc.resolve(records).select(
        warc.urn_id(F.col("record_id")).cast("long"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.urn_id(F.col("refers_to")).cast("long"),
    )
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("chunk_bytes, min_bytes", [(64, 0), (1 << 20, 0), (7, 64)])
def test_round_trip(spark, tmp_path, chunk_bytes, min_bytes):
    rows = [*enumerate(payloads())] + [(None, "no id"), (None, payloads()[3]), (5, payloads()[5]), (5, payloads()[5]), (7, "other")]
    df = pages(spark, rows)
    path = warc.write_archives(df, F.col("page_id"), F.col("html"), f"{tmp_path}/w", min_bytes, chunk_bytes, archives=3)
    assert len(glob.glob(f"{path}/*.gz")) == 3
    records = warc.read_archives(spark, path, 50)
    assert resolved(records) == expected(rows, min_bytes)
    # The bytes come back whole, in chunks that carry the length and digest so far.
    by_record = {}
    for r in records.collect():
        by_record.setdefault(r["record_id"], []).append(r)
    seen = []
    for chunks in by_record.values():
        chunks.sort(key=lambda r: r["chunk"])
        data = b""
        for n, r in enumerate(chunks):
            data += bytes(r["data"])
            assert (r["chunk"], r["n_bytes"], r["digest"]) == (n, len(data), b32(data))
            assert r["last"] == (r is chunks[-1]) and len(r["data"]) < 50 + chunk_bytes + 3
        if r["record_type"] == "response":
            assert r["declared_digest"] == r["digest"]
            seen.append(data)
    want = [r for r in expected(rows, min_bytes) if r[3] == "response"]
    assert sorted(map(b32, seen)) == sorted(r[2] for r in want)
    urls = {r["target_uri"] for r in records.where("chunk = 0").collect()}
    assert None in urls and "http://h/1%0D%0AX: 1" in urls


def test_an_independent_parser_finds_whole_records(spark, tmp_path):
    rows = [*enumerate(payloads())]
    path = warc.write_archives(pages(spark, rows), F.col("page_id"), F.col("html"), f"{tmp_path}/w", chunk_bytes=64)
    found = 0
    for name in glob.glob(f"{path}/*.gz"):
        data, at = gzip.open(name).read(), 0
        while at < len(data):
            head, _, rest = data[at:].partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            block = rest[: int(fields[b"Content-Length"])]
            at += len(head) + 4 + len(block)
            assert head.startswith(b"WARC/1.1\r\n") and data[at : at + 4] == b"\r\n\r\n"
            at += 4
            found += 1
            body = block.partition(b"\r\n\r\n")[2]
            if fields[b"WARC-Type"] == b"revisit":
                assert body == b"" and b"WARC-Refers-To" in fields
                continue
            payload = b""
            while True:
                size, _, body = body.partition(b"\r\n")
                if not int(size, 16):
                    break
                payload += body[: int(size, 16)]
                assert body[int(size, 16) :][:2] == b"\r\n"
                body = body[int(size, 16) + 2 :]
            assert body == b"\r\n" and fields[b"WARC-Payload-Digest"].decode() == "sha1:" + b32(payload)
    assert found == len(rows)


def record(kind, body, http=b"", **fields):
    block = (b"HTTP/1.1 200 OK\r\n" + http + b"\r\n" + body) if kind != "metadata" else body
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{fields.pop('name')}>", "Content-Length": len(block), **fields}
    if kind != "metadata":
        head["content-type"] = "application/http;msgtype=response"
    return "WARC/1.0\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    body = b"line\r\n\r\n" + b"z" * 300 + b"\r\r\n" + b"q" * 90 + b"\r\n"
    whole = [
        record("metadata", b"", name="a"),
        record("metadata", b"about: it\r\n", name="b"),
        record("response", body, b"Server: x\r\n", name="c"),
        record("response", b"", name="d"),
        record("revisit", b"", name="e", **{"WARC-Refers-To": "<urn:uuid:c>", "WARC-Payload-Digest": "sha1:" + b32(body)}),
        record("revisit", b"", name="f", **{"WARC-Refers-To": "<urn:uuid:gone>"}),
    ]
    (tmp_path / "per-record.warc.gz").write_bytes(b"".join(map(gzip.compress, whole)))
    (tmp_path / "plain.warc").write_bytes(record("response", b"plain", name="g") + record("response", body, name="cut")[:-60])
    (tmp_path / "empty.warc").write_bytes(b"")
    records = warc.read_archives(spark, str(tmp_path), 100)
    got = {r["record_id"][10:-1]: r for r in warc.resolve(records).collect()}
    size = {k: (r["payload_bytes"], r["payload_digest"]) for k, r in got.items()}
    assert size == {
        "a": (0, b32(b"")), "b": (11, b32(b"about: it\r\n")), "c": (len(body), b32(body)), "d": (0, b32(b"")),
        "e": (len(body), b32(body)), "f": (None, None), "g": (5, b32(b"plain")),
    }
    assert records.where("record_id = '<urn:uuid:cut>' AND last").count() == 0
    assert records.where("record_id = '<urn:uuid:c>'").count() == 2  # the run of z exceeds a chunk


def test_what_is_no_archive_fails(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(b"no archive\r\n")
    with pytest.raises(Exception, match="must start with its version"):
        warc.read_archives(spark, str(tmp_path)).count()


def test_empty_table(spark, tmp_path):
    path = warc.write_archives(pages(spark, []), F.col("page_id"), F.col("html"), f"{tmp_path}/w")
    assert warc.resolve(warc.read_archives(spark, path)).count() == 0
