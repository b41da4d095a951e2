"""Tar shards: whole or not at all, members and lines of any length, ranges of bytes."""

from __future__ import annotations

import io
import os
import tarfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codelore.sources import scans, shards


def tar_of(path, members, form=tarfile.PAX_FORMAT):
    with tarfile.open(path, "w", format=form) as tar:
        folder = tarfile.TarInfo("folder")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)
        for name, raw in members:
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))


@pytest.mark.parametrize(("step", "span", "text"), [(1 << 20, 64 << 20, 4 << 20), (7, 600, 40)])
def test_lines_are_whole_at_any_step_and_range(spark, tmp_path, monkeypatch, step, span, text):
    for name, value in (("STEP", step), ("RANGE", span), ("TEXT", text), ("MEMBERS", 2)):
        monkeypatch.setattr(shards, name, value)
    long = "n" * 300 + ".jsonl"
    a = [("a.jsonl", b'{"x":1}\n\n \n{"x":2}\n'), (long, "é\r\nzwei\n".encode() * 40 + "ende".encode()), ("empty.jsonl", b""), ("other.txt", b"no\n")]
    tar_of(tmp_path / "one.tar", a)
    tar_of(tmp_path / "two.tar", a[1:2], tarfile.GNU_FORMAT)
    tar_of(tmp_path / "none.tar", [])
    (tmp_path / "not-a-tar.txt").write_text("x")
    want = []
    for tar, members in (("one", a), ("two", a[1:2])):
        for name, raw in members:
            if name.endswith(".jsonl"):
                want += [(tar, name[:-6], i, line) for i, line in enumerate(raw.decode().split("\n")) if line.strip()]
    got = shards.scan_shards(spark, str(tmp_path)).select(F.regexp_extract("path", r"(\w+)\.tar$", 1), "member", "line_no", "json")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_tar_cut_off_is_an_error(spark, tmp_path):
    tar_of(tmp_path / "one.tar", [("a.jsonl", b"x" * 5000)])
    os.truncate(tmp_path / "one.tar", 3000)
    with pytest.raises(Exception):
        shards.scan_shards(spark, str(tmp_path)).collect()


def test_written_members_come_back(spark, tmp_path):
    rows = spark.createDataFrame(
        [(s, f"m{i}.json", f'{{ "s": "{s}",\n "i": {i}, "t": "é" }}') for s in ("p-0", "p-1", "q-0") for i in range(30)] + [("p-0", "null.json", None), (None, "m.json", "x"), ("q-0", None, "x")],
        "shard string, member string, text string",
    )
    path = f"file:{tmp_path}/out"
    shards.write_shards(rows, path)
    assert sorted(os.listdir(tmp_path / "out")) == ["p-0.tar", "p-1.tar", "q-0.tar"]
    with tarfile.open(tmp_path / "out" / "p-0.tar") as tar:
        assert tar.getnames() == sorted(["null.json", *[f"m{i}.json" for i in range(30)]])
    back = shards.scan_members(spark, path)
    assert back.count() == 91 and back.where("text = ''").count() == 1
    lines = scans.json_archive_to_lines(back.where("text <> ''")).where("member = 'm7.json'")
    assert sorted(r["json"] for r in lines.collect()) == [f'{{"s":"{s}","i":7,"t":"é"}}' for s in ("p-0", "p-1", "q-0")]


def test_a_job_that_fails_leaves_no_shard(spark, tmp_path):
    broken = F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.lit("x"))
    rows = spark.range(100).select((F.col("id") % 5).alias("shard"), F.concat("id", F.lit(".jsonl")).alias("member"), broken.cast("string").alias("text"))
    (tmp_path / "out").mkdir()
    with pytest.raises(Exception):
        shards.write_shards(rows, str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == []


def test_an_attempt_that_does_not_count_leaves_nothing(tmp_path):
    writer = shards.ShardWriter(str(tmp_path))
    batch = pa.RecordBatch.from_pydict({"shard": ["0", "0", "1"], "member": ["a", "b", "c"], "text": ["x", None, "y"]})
    writer.write(iter([batch]))
    counts = writer.write(iter([batch.slice(0, 1), batch.slice(1)]))
    writer.commit([counts, None])
    assert sorted(os.listdir(tmp_path)) == ["0.tar", "1.tar"]
    with tarfile.open(tmp_path / "0.tar") as tar:
        assert [(m.name, m.size) for m in tar] == [("a", 1), ("b", 0)]
