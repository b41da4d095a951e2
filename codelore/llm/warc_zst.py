"""WARC archives compressed with Zstandard, a dictionary in front and a frame for each record.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself a frame; each
record after it is a frame of its own.  Archives are rows of (archive, content), a table that
Spark writes to and reads from any store; ``spark.read.format("binaryFile")`` reads archives made elsewhere.  Each
task packs its own records, up to a number of bytes an archive, so that no record is shuffled.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_lookup

# Fixed values of the formats.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads from so many bytes on are written once.
LEAST_SHARED = 100
#: Bytes of records an archive, and of records that its dictionary is trained on.
ARCHIVE_BYTES, TRAINING_BYTES, DICTIONARY_BYTES, LEVEL = 8 << 20, 1 << 20, 16 << 10, 3
DATE = "2024-01-01T00:00:00Z"


def with_revisits(pages: DataFrame) -> DataFrame:
    """Add payload, payload_bytes, payload_digest, record_type and refers_to to pages(page_id, url, html).

    Of rows with equal payloads of at least 100 bytes, those with the smallest page_id are responses and the
    others refer to it.  Rows without a page_id are responses.  Repeated rows are records of their own; an
    empty table stays empty.
    """
    rows = pages.withColumn("payload", F.coalesce(F.col("html"), F.lit("")).cast("binary")).drop("html")
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    shared = F.when(F.col("payload_bytes") >= LEAST_SHARED, F.col("payload_digest"))
    # Only the digest is carried into the count of equal payloads; most have no second page.
    first = rows.withColumn("_digest", shared).where(F.col("_digest").isNotNull()).groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("page_id").alias("_n")).where(F.col("_n") > 1).drop("_n")
    rows = salted_lookup(rows.withColumn("_digest", shared), first, "_digest", F.col("page_id")).drop("_digest")
    again = F.col("page_id") > F.col("_first")
    return rows.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("_first"))).drop("_first")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=blake2b(f'{page_id} {digest}'.encode(), digest_size=16).digest(), version=4)}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, a response with its payload or a revisit without."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else "%%%02X" % ord(c) for c in url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Block-Digest: sha256:{sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack_archive(records: list[bytes]) -> bytes:
    """A dictionary trained on the first records, then a frame for each."""
    samples, size = [], 0
    for r in records:
        samples.append(r[: 64 << 10])
        size += len(samples[-1])
        if size > TRAINING_BYTES:
            break
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too few or too small samples
        trained = None
    raw = trained.as_bytes() if trained else b""
    held = zstandard.ZstdCompressor(level=LEVEL).compress(raw)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True) if trained else zstandard.ZstdCompressor(level=LEVEL)
    return b"".join([struct.pack("<II", SKIPPABLE, len(held)), held, *map(packer.compress, records)])


def write_archives(records: DataFrame) -> DataFrame:
    """Archives, rows of (archive, content), of records(page_id, url, payload, payload_digest, refers_to).

    A record may be longer than an archive is to be; it is then the last of its own.  An empty table gives no archives.
    """

    def run(batches):
        kept: list[bytes] = []
        size = 0

        def packed() -> pa.RecordBatch:
            content = pack_archive(kept)
            name = f"{sha256(content).hexdigest()[:32]}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "payload_digest", "refers_to"))):
                kept.append(record(*(x.as_py() for x in row)))
                size += len(kept[-1])
                if size >= ARCHIVE_BYTES:
                    yield packed()
                    kept, size = [], 0
        if kept:
            yield packed()

    return records.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(run, "archive string, content binary")


def save_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive to a file of its name; ``archive, bytes`` of every file.

    ``folder`` is a path or address that pyarrow.fs opens and that all executors and the driver share.  A file
    appears by a rename, and its name is a digest of its content, so that a task that runs again leaves the same files.
    ``spark.read.format("binaryFile")`` reads them for ``read_archives(files, "path")``.
    """

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column("archive"), batch.column("content")):
                raw, path = content.as_py(), f"{base}/{name.as_py()}"
                part = f"{base}/.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(raw)
                store.move(part, path)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column("archive"), pa.array(sizes, pa.int64())], names=["archive", "bytes"])

    return cut(archives.select("archive", "content").mapInArrow(run, "archive string, bytes long"))


def frames(content: bytes) -> Iterator[tuple[bytes, str]]:
    """Each frame's bytes and what is wrong with it, empty if nothing; a broken frame ends the archive."""
    data = memoryview(content)
    dictionary, at = None, 0
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        (length,) = struct.unpack_from("<I", data, 4)
        raw = bytes(data[8 : 8 + length])
        at = 8 + length
        if len(raw) < length:
            yield b"", "dictionary cut short"
            return
        if raw[:4] == struct.pack("<I", FRAME):
            unpacked = zstandard.ZstdDecompressor().decompressobj()
            try:
                raw = unpacked.decompress(raw)
            except zstandard.ZstdError:
                raw = None
            if raw is None or not unpacked.eof:
                yield b"", "broken dictionary"
                return
        dictionary = zstandard.ZstdCompressionDict(raw) if raw else None
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at >= 8 and 0x184D2A50 <= struct.unpack_from("<I", data, at)[0] <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        step = reader.decompressobj()
        try:
            out = [step.decompress(data[at : at + (64 << 10)])]
            end = at + (64 << 10)
            while not step.eof and end < len(data):
                out.append(step.decompress(data[end : end + (64 << 10)]))
                end += 64 << 10
        except zstandard.ZstdError:
            yield b"", "broken frame"
            return
        if not step.eof:
            yield b"".join(out), "frame cut short"
            return
        at = min(end, len(data)) - len(step.unused_data)
        yield b"".join(out), ""


def read_record(raw: bytes) -> dict:
    """Headers, block and digests of a record; ``error`` says what doesn't hold, empty if all does."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    named = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    out = {"headers": named, "payload": b"", "payload_bytes": 0, "payload_digest": None, "error": ""}

    def wrong(what: str) -> dict:
        return out | {"error": what}

    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        return wrong("no WARC header")
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not named.get(needed):
            return wrong(f"no {needed}")
    if not named["content-length"].isdigit() or len(rest) != int(named["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        return wrong("length differs")
    block = rest[:-4]
    kept = named.get("warc-block-digest", "").partition(":")
    if kept[0] == "sha256" and kept[2] != sha256(block).hexdigest():
        return wrong("block digest differs")
    http, mark, payload = block.partition(b"\r\n\r\n")
    digest = named.get("warc-payload-digest", "").partition(":")[2] or None
    length = next((x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
    if not mark or not length.isdigit():
        return wrong("no HTTP header")
    out |= {"payload": payload, "payload_bytes": int(length), "payload_digest": digest}
    if named["warc-type"] == "response":
        if len(payload) != int(length):
            return wrong("payload length differs")
        if digest is not None and sha256(payload).hexdigest() != digest:
            return wrong("payload digest differs")
    elif named["warc-type"] == "revisit" and (payload or not named.get("warc-refers-to")):
        return wrong("revisit with a payload or without a target")
    return out


def read_archives(archives: DataFrame, name: str = "archive", payloads: bool = True) -> DataFrame:
    """Records of archives: archive, page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, error.

    A task holds one archive at a time.  What is broken gives a row that says so; a null or empty content gives none.
    """

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column(name).to_pylist(), batch.column("content")):
                rows = []
                for raw, error in frames(content.as_py() or b""):
                    got = read_record(raw) if not error else {"headers": {}, "payload": b"", "payload_bytes": None, "payload_digest": None, "error": error}
                    named = got["headers"]
                    number = lambda k: int(v) if (v := named.get(k, "")).lstrip("-").isdigit() else None
                    rows.append((archive, number("x-page-id"), named.get("warc-target-uri"), named.get("warc-type"), number("x-refers-to-page"), got["payload_bytes"], got["payload_digest"], got["payload"] if payloads else None, got["error"] or None))
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORDS)], schema=RECORDS)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORDS)], schema=RECORDS)

    return archives.select(name, "content").mapInArrow(run, "archive string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string")


RECORDS = pa.schema([("archive", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())])
