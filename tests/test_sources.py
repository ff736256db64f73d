from __future__ import annotations

import io
import os
import tarfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seqloom.plans import extraction
from seqloom.sources import archives, arrays, files, readers, writers


def test_array_slices_and_headers(spark, tmp_path):
    matrix = np.arange(60, dtype=np.float64).reshape(20, 3)
    for name, value in {"1_visual": matrix, "2_visual": matrix[:, 0].astype(np.float32)}.items():
        np.save(tmp_path / f"{name}.npy", value)
    np.save(tmp_path / "3_visual.npy", np.zeros((0, 3)))
    (tmp_path / "4_visual.npy").write_bytes(b"not an array")
    np.save(tmp_path / "5_visual.npy", np.asfortranarray(matrix))
    (tmp_path / "6_visual.npy").write_bytes(b"")
    listing = files.list_files(spark, str(tmp_path), "*.npy")
    shapes = {os.path.basename(r["path"]): r for r in arrays.array_shapes(listing).collect()}
    assert shapes["6_visual.npy"]["error"] and shapes["6_visual.npy"]["rows"] is None
    assert (shapes["1_visual.npy"]["rows"], shapes["1_visual.npy"]["width"]) == (20, 3)
    assert shapes["2_visual.npy"]["dtype"] == "float32" and shapes["2_visual.npy"]["width"] == 1
    assert shapes["4_visual.npy"]["error"] and shapes["5_visual.npy"]["by_column"]
    with pytest.raises(PySparkException, match="[46]_visual.npy"):
        arrays.read_arrays(listing, slice_rows=6).collect()
    rows = arrays.read_arrays(listing, slice_rows=6, skip_damaged=True)
    for name in ("1_visual", "5_visual"):
        got = rows.where(F.col("path").contains(name)).orderBy("t").collect()
        np.testing.assert_array_equal(np.array([r["features"] for r in got]), matrix)
    wide = files.modality_files(listing).where("subject_id = '1'").first()
    assert wide["acoustic_path"] is None and wide["visual_path"].endswith("1_visual.npy")


def visual_text(rows):
    header = ", ".join(readers.VISUAL_REQUIRED)
    return "\n".join([header, *rows])


def visual_row(ts, value="1.5"):
    return f" {ts} , 0.9, 1.0, " + ", ".join([value] * len(readers.VISUAL_FEATURES))


def write_archive(path, members):
    with tarfile.open(path, "w:gz") as tar:
        for name, text in members.items():
            info = tarfile.TarInfo(f"folder/{name}")
            payload = text.encode("utf-8", errors="surrogateescape")
            info.size = len(payload)
            tar.addfile(info, io.BytesIO(payload))


def payload(kind, pid):
    return archives.PAYLOADS[kind].format(pid=pid)


def test_extraction_of_good_and_damaged_archives(spark, tmp_path):
    rng = np.random.default_rng(0)
    good = visual_text([visual_row(0.1), visual_row("bad"), visual_row(0.4, "x"), visual_row(1.2)])
    # incompressible, so that cutting the file really cuts the second member
    long_acoustic = "\n".join(
        ["name;frameTime;loud", *[f"'f';{i / 10};{rng.normal()}" for i in range(20000)]]
    )
    acoustic = "name;frameTime;loud\n'f';0.0;1.5\n\"f;g\";0.5;2.5\n'f';0.6;\n'f';0.7"
    write_archive(tmp_path / "300_P.tar.gz",
                  {payload("visual", 300): good, "readme.txt": "x", payload("acoustic", 300): acoustic})
    write_archive(tmp_path / "301_P.tar.gz",
                  {payload("visual", 301): good, payload("acoustic", 301): long_acoustic})
    whole = (tmp_path / "301_P.tar.gz").read_bytes()
    (tmp_path / "301_P.tar.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "302_P.tar.gz").write_bytes(b"this is no archive")
    (tmp_path / "304_P.tar.gz").write_bytes(b"")
    write_archive(tmp_path / "303_P.tar.gz", {payload("visual", 303): "timestamp, success\n1, 1",
                                              payload("acoustic", 303): acoustic})
    (tmp_path / "notes.tar.gz").write_bytes(b"x")
    table = archives.archive_table(files.list_files(spark, str(tmp_path), "*.tar.gz"))
    result = extraction.extract(table)
    meta = {r["subject_id"]: r for r in result.metadata.collect()}
    assert set(meta) == {"300_P", "301_P", "302_P", "303_P", "304_P"}
    assert {k: v["status"] for k, v in meta.items()} == {
        "300_P": "success", "301_P": "partial", "302_P": "failed", "303_P": "partial",
        "304_P": "failed",
    }
    assert meta["300_P"]["warnings"] == []
    assert (meta["300_P"]["visual_len"], meta["300_P"]["visual_dim"]) == (2, 49)
    assert (meta["300_P"]["acoustic_len"], meta["300_P"]["acoustic_dim"]) == (2, 1)
    assert meta["301_P"]["warnings"][-1] == "partial_subject_recovered"
    assert len(meta["301_P"]["warnings"]) >= 2
    assert meta["302_P"]["warnings"][-1] == "no_required_features_recovered"
    assert any(w.startswith("visual_parse_error: Missing columns: AU01_c") for w in meta["303_P"]["warnings"])
    frames = result.acoustic.where("participant = 300").orderBy("ts").collect()
    assert [(r["ts"], r["features"]) for r in frames] == [(0.0, [1.5]), (0.5, [2.5])]
    left = extraction.pending_archives(table, result.metadata)
    assert {r["participant"] for r in left.collect()} == {301, 302, 303, 304}
    listed = archives.list_members(archives.first_archives(table, 3)).collect()
    assert {r["archive"] for r in listed} == {"300_P.tar.gz", "301_P.tar.gz", "302_P.tar.gz"}


def test_an_archive_is_inflated_once(tmp_path, monkeypatch):
    names = {payload("visual", 320): "visual", payload("acoustic", 320): "acoustic"}
    write_archive(tmp_path / "320_P.tar.gz", {payload("visual", 320): "a\nb", "x.txt": "x",
                                              payload("acoustic", 320): "c", "after.txt": "y"})
    opened, real = [], archives.open_sequential

    def counting(path):
        opened.append(path)
        return real(path)

    monkeypatch.setattr(archives, "open_sequential", counting)
    found = list(archives._records(str(tmp_path / "320_P.tar.gz"), names))
    assert found == [
        ("line", "visual", 0, 0, "a"),
        ("line", "visual", 0, 1, "b"),
        ("whole", "visual", 0, 2, None),
        ("line", "acoustic", 2, 0, "c"),
        ("whole", "acoustic", 2, 1, None),
    ]
    assert len(opened) == 1


def test_lines_of_a_member_cut_short_are_staged_but_not_given_out(spark, tmp_path):
    rng = np.random.default_rng(1)
    text = "\n".join(["name;frameTime;loud", *[f"'f';{i / 10};{rng.normal()}" for i in range(40000)]])
    write_archive(tmp_path / "330_P.tar.gz", {payload("acoustic", 330): text})
    whole = (tmp_path / "330_P.tar.gz").read_bytes()
    (tmp_path / "330_P.tar.gz").write_bytes(whole[: len(whole) // 2])
    table = archives.archive_table(files.list_files(spark, str(tmp_path), "*.tar.gz"))
    staged = archives.stage_payloads(table)
    assert staged.where("record = 'line'").count() > 1000
    assert staged.where("record = 'whole'").count() == 0
    assert archives.payload_lines(staged).count() == 0
    assert extraction.extract(table).acoustic.count() == 0
    assert archives.read_payload_lines(table.limit(0)).count() == 0


def test_listing_shows_empty_files_and_hides_what_spark_hides(spark, tmp_path):
    for name, data in {"a.bin": b"xy", "b.bin": b"", "c.txt": b"z", "_d.bin": b"1", "s/t/e.bin": b"123",
                       "_tmp/f.bin": b"1", "s/.h/g.bin": b"1"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    listed = files.list_files(spark, str(tmp_path), "*.bin").collect()
    assert {(r["path"], r["length"]) for r in listed} == {
        (f"file:{tmp_path}/{name}", size) for name, size in (("a.bin", 2), ("b.bin", 0), ("s/t/e.bin", 3))
    }
    spark_paths = {r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True)
                   .option("pathGlobFilter", "*.bin").load(str(tmp_path)).select("path").collect()}
    assert spark_paths == {r["path"] for r in listed if r["length"] > 0}
    (tmp_path / "none").mkdir()
    assert files.list_files(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(PySparkException):
        files.list_files(spark, str(tmp_path / "absent")).count()


def test_the_last_member_of_a_name_counts(spark, tmp_path):
    name = archives.PAYLOADS["acoustic"].format(pid=310)
    lines = {f"old/{name}": "name;frameTime;loud\n'f';0.0;1.5\n'f';1.0;1.5", f"new/{name}": "name;frameTime;loud\n'f';0.0;9.5"}
    write_archive(tmp_path / "310_P.tar.gz", lines)
    result = extraction.extract(archives.archive_table(files.list_files(spark, str(tmp_path), "*.tar.gz")))
    assert [r["features"] for r in result.acoustic.collect()] == [[9.5]]
    assert [r["acoustic_len"] for r in result.metadata.collect()] == [1]


def test_delimited_files(spark, tmp_path):
    (tmp_path / "v.csv").write_text(visual_text([visual_row(0.5), visual_row("nope"), visual_row(2)]))
    rows = readers.read_visual_csv(spark, str(tmp_path / "v.csv")).orderBy("ts").collect()
    assert [(r["ts"], len(r["features"]), r["success"]) for r in rows] == [(0.5, 49, 1), (2.0, 49, 1)]
    (tmp_path / "a.csv").write_text("name; frameTime;a; b\n'x';0.25;1;2\n'x';0.5;;2\n")
    rows = readers.read_acoustic_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [(r["ts"], r["features"]) for r in rows] == [(0.25, [1.0, 2.0])]
    (tmp_path / "bad.csv").write_text("timestamp,success\n1,1\n")
    with pytest.raises(ValueError, match="Missing columns.*AU01_c"):
        readers.read_visual_csv(spark, str(tmp_path / "bad.csv"))


def test_number_parsing(spark):
    texts = [" 1.5 ", "1e3", "nan", "inf", "-inf", "", "bad", "1.5f", "2d", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from seqloom.functions.labels import tolerant_double

    got = [r[0] for r in df.select(tolerant_double(F.col("t"))).collect()]
    assert got[:2] == [1.5, 1000.0] and got[2] != got[2]
    assert got[3:5] == [float("inf"), float("-inf")] and got[5:] == [None] * 5


def test_incremental_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "done")
    todo = spark.range(5).withColumnRenamed("id", "k")
    calls = []

    def work(df):
        calls.append(df.count())
        return df

    writers.run_incremental(todo.where("k < 3"), path, ["k"], work)
    writers.run_incremental(todo, path, ["k"], work)
    assert writers.run_incremental(todo, path, ["k"], work).count() == 5
    assert calls == [3, 2, 0]


def test_labels_by_prefix(spark, tmp_path):
    names = [f"PHQ8_{i}_x" for i in range(1, 9)]
    (tmp_path / "e.csv").write_text(
        "Participant," + ",".join(names) + ",Depression_label,split,gender,age\n"
        "300,1,1,1,1,1,1,1,,0,train,male,\n301,3,3,3,3,3,3,3,3,1,dev,female, 41\n"
    )
    rows = readers.read_labels_e(spark, str(tmp_path / "e.csv")).orderBy("participant").collect()
    assert [(r["phq"], r["age"], r["label_binary"]) for r in rows] == [(7, -1, 0), (24, 41, 1)]
