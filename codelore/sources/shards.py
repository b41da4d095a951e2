"""Tar shards of any size: members written as a stream with a commit, and read by ranges of bytes."""

from __future__ import annotations

import io
import re
import tarfile
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes of a shard that one task reads, bytes of one read, and members or bytes of text in one batch.
RANGE, STEP, MEMBERS, TEXT = 16 << 20, 1 << 20, 4096, 4 << 20


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """Shards that a task has finished, under the names that only this attempt uses."""

    names: list[tuple[str, str]]


class ShardWriter(DataSourceArrowWriter):
    """Tasks write under names of their own; the commit gives the shards of the attempts that count their names."""

    def __init__(self, path: str, pieces: bool = False):
        self.path, self.begun, self.pieces = path, f"_temporary-{uuid4().hex}", pieces

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = store(f"{self.path}/{self.begun}")
        files.create_dir(root)
        names, shard, out, tar, last, held = [], None, None, None, None, None

        def close_member() -> None:
            info = tarfile.TarInfo(last)
            info.size = held.tell()
            held.seek(0)
            tar.addfile(info, held)
            held.close()

        for batch in iterator:
            for name, member, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "member", "text"))):
                new = tar is None or name != shard
                if held is not None and (new or member != last or not self.pieces):
                    close_member()
                    held = None
                if new:
                    if tar is not None:
                        tar.close()
                        out.close()
                    shard, attempt = name, uuid4().hex
                    names.append((attempt, f"{name}.tar"))
                    out = files.open_output_stream(f"{root}/{attempt}")
                    tar = tarfile.open(fileobj=out, mode="w|")
                if held is None:
                    # The header has the size, so that a long member of pieces waits in the task's own folder.
                    last, held = member, tempfile.SpooledTemporaryFile(TEXT) if self.pieces else io.BytesIO()
                held.write((text or "").encode("utf-8"))
        if tar is not None:
            close_member()
            tar.close()
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = store(self.path)
        for message in messages:
            for attempt, name in message.names if message else []:
                files.move(f"{root}/{self.begun}/{attempt}", f"{root}/{name}")
        self._clear(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*store(self.path))

    def _clear(self, files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/{self.begun}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.begun}")


class TarShards(DataSource):
    """The sink ``tar_shards`` of rows (shard, member, text), those of a shard in one task and together.

    With a column ``piece`` the texts of a member that follow each other are one text.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        if overwrite:
            raise ValueError("tar_shards adds shards to a folder; it doesn't replace one")
        return ShardWriter(self.options["path"], "piece" in schema.fieldNames())


def write_shards(rows: DataFrame, path: str) -> None:
    """A tar ``<shard>.tar`` a shard of rows(shard, member, text) in a folder, members by name.

    A null text is an empty member; rows without a shard or member are left out.  A shard stands there whole or not at
    all: tasks that fail, run twice or are left behind leave nothing.  A task holds one batch of rows.  With a column
    ``piece`` a member may come in any number of rows, whose texts are joined in its order; no row has to hold it whole.
    """
    rows.sparkSession.dataSource.register(TarShards)
    pieces = ["piece"] if "piece" in rows.columns else []
    kept = rows.select(F.col("shard").cast("string"), F.col("member").cast("string"), "text", *pieces).where("shard is not null and member is not null")
    kept.repartition("shard").sortWithinPartitions("shard", "member", *pieces, "text").write.format("tar_shards").mode("append").save(path)


def shard_members(spark: SparkSession, path: str) -> DataFrame:
    """``path, member, at, size`` of the files in the tars of a folder, from their headers; a task a tar, which jumps over
    what the members hold."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                files, place = store(path)
                found = []
                with files.open_input_file(place) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                    while (info := tar.next()) is not None:
                        tar.members = []  # which would keep every header
                        if info.isfile():
                            found.append((path, info.name, info.offset_data, info.size))
                        if len(found) == MEMBERS:
                            yield pd.DataFrame(found, columns=["path", "member", "at", "size"])
                            found = []
                if found:
                    yield pd.DataFrame(found, columns=["path", "member", "at", "size"])

    return _tars(spark, path).select("path").repartition(F.col("path")).mapInPandas(walk, "path string, member string, at long, size long")


def _tars(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of the tars; their contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").option("recursiveFileLookup", "true").load(path).select("path", "length")


def _dealt(spark: SparkSession, path: str, members: DataFrame) -> DataFrame:
    """Members over tasks by ranges of bytes, so that one tar goes to many tasks."""
    tasks = 1 + (_tars(spark, path).agg(F.sum("length")).first()[0] or 0) // RANGE
    return members.repartition(tasks, "path", F.floor(F.col("at") / RANGE)).sortWithinPartitions("path", "at")


def scan_shards(spark: SparkSession, path: str) -> DataFrame:
    """``path, member, line_no, json`` of every non-empty line of the .jsonl members in the tars of a folder.

    Members are read a step at a time, whatever their size and that of their tar, and their lines cut as Arrow columns; a
    line has to fit in memory.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, f = None, None
        for batch in batches:
            parts, held = [], 0
            for path, member, at, size in zip(*(batch.column(c).to_pylist() for c in ("path", "member", "at", "size"))):
                if path != last:
                    files, place = store(path)
                    f, last = files.open_input_file(place), path
                f.seek(at)
                n, left, rest = 0, size, []
                while left:
                    data = f.read(min(STEP, left))
                    if not data:
                        raise EOFError(f"{path} ends within {member}")
                    left -= len(data)
                    end = data.rfind(b"\n") + 1 if left else len(data)
                    if not end:
                        rest.append(data)
                        continue
                    whole, rest = b"".join([*rest, data[:end]]), [data[end:]]
                    found = pc.split_pattern(pa.array([whole], pa.binary()), b"\n").flatten().cast(pa.string())
                    found = found[:-1] if whole.endswith(b"\n") else found
                    kept = pc.not_equal(pc.ascii_trim(found, " \t\n\r\v\f"), "")
                    numbers = pa.array(np.arange(n, n + len(found)))
                    n, found = n + len(found), found.filter(kept)
                    parts.append([pa.repeat(path, len(found)), pa.repeat(member[: -len(".jsonl")], len(found)), numbers.filter(kept), found])
                    held += len(whole)
                    if held > TEXT:
                        yield _joined(parts)
                        parts, held = [], 0
            if parts:
                yield _joined(parts)

    members = shard_members(spark, path).where(F.col("member").endswith(".jsonl"))
    return _dealt(spark, path, members).mapInArrow(lines, "path string, member string, line_no long, json string")


def _joined(parts: list[list[pa.Array]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts)], names=["path", "member", "line_no", "json"])


def scan_members(spark: SparkSession, path: str) -> DataFrame:
    """``path, member, text`` of the tars of a folder, a member a row; small ones go on together."""

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, f = None, None
        for frame in frames:
            rows, held = [], 0
            for path, member, at, size in frame.itertuples(index=False):
                if path != last:
                    files, place = store(path)
                    f, last = files.open_input_file(place), path
                if rows and held + size > TEXT:
                    yield pd.DataFrame(rows, columns=["path", "member", "text"])
                    rows, held = [], 0
                f.seek(at)
                rows.append((path, member, f.read(size).decode("utf-8")))
                held += size
            if rows:
                yield pd.DataFrame(rows, columns=["path", "member", "text"])

    return _dealt(spark, path, shard_members(spark, path)).mapInPandas(whole, "path string, member string, text string")
