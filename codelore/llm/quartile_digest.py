"""Fingerprints of whole texts by quartiles of hashed byte triplets.

Every three neighbouring bytes, and every two skips among four, hash into one of 128 buckets.  The
fingerprint says of each bucket in which quarter of the bucket counts it lies, two bits each, after a byte for the
logarithm of the length and a byte for how the quartiles relate.  Two fingerprints differ by a bounded score:
the steps between lengths, ratios and buckets, where opposite quarters count double; likeness is one less its share of a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Texts, cut, string_chunks

BUCKETS = 128
#: Difference from which the likeness is nought.
BOUND = 300
# Opposite quarters count 6, as far as two inner steps each way.
_STEP = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], np.int32)


def digests(chunk: Texts) -> np.ndarray:
    """A row of 2 + BUCKETS / 4 bytes for each text."""
    data, n = chunk.data.astype(np.uint32), len(chunk)
    counts = np.zeros((n, BUCKETS), np.int64)
    of = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, np.diff(chunk.at))
    for k, (i, j) in enumerate(((1, 2), (1, 3), (2, 3))):
        if len(data) <= j:
            continue
        m = len(data) - j
        h = data[:m] * np.uint32(0x9E3779B1) + data[i : i + m] * np.uint32(0x85EBCA77) + data[j:] * np.uint32(0xC2B2AE3D) + np.uint32(k * 0x27D4EB2F)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h = (h >> np.uint32(16)) & np.uint32(BUCKETS - 1)
        inside = of[:m] == of[j:]
        counts += np.bincount((of[:m] + h)[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)
    ranked = np.sort(counts, axis=1)
    q1, q2, q3 = (ranked[:, BUCKETS * k // 4 - 1][:, None] for k in (1, 2, 3))
    code = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(n, BUCKETS // 4, 4)
    body = (code << np.array([0, 2, 4, 6], np.uint8)).sum(axis=2).astype(np.uint8)
    size = np.diff(chunk.at)
    head = np.zeros((n, 2), np.uint8)
    head[:, 0] = np.minimum(255, np.floor(8 * np.log2(1 + size)))
    top = np.maximum(q3[:, 0], 1)
    head[:, 1] = (15 * q1[:, 0] // top) * 16 + 15 * q2[:, 0] // top
    return np.concatenate([head, body], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness from 0 to 1 of the fingerprints in the same rows."""
    a, b = np.atleast_2d(a), np.atleast_2d(b)
    length = np.abs(a[:, 0].astype(np.int32) - b[:, 0])
    ratios = np.abs((a[:, 1] >> 4).astype(np.int32) - (b[:, 1] >> 4)) + np.abs((a[:, 1] & 15).astype(np.int32) - (b[:, 1] & 15))
    body = sum(_STEP[(a[:, 2:] >> s) & 3, (b[:, 2:] >> s) & 3].sum(axis=1) for s in (0, 2, 4, 6))
    differ = np.minimum(BOUND, body + 2 * np.minimum(length, 32) + np.minimum(ratios, 16))
    return np.where((a == b).all(axis=1), 1.0, 1.0 - differ / BOUND)


def _all(texts: list[str]) -> np.ndarray:
    parts = [digests(chunk) for _, chunk in string_chunks(pa.array(texts, pa.large_string()))]
    return np.concatenate(parts) if parts else np.zeros((0, 2 + BUCKETS // 4), np.uint8)


def fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``fingerprint``, in hexadecimal, to every row; a null text counts as empty.  Equal texts have equal ones."""
    keep = [c for c in df.columns if c != "fingerprint"]

    def run(batches):
        for batch in batches:
            out = [row.tobytes().hex() for _, chunk in string_chunks(batch.column(text)) for row in digests(chunk)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], names=[*keep, "fingerprint"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return df.select(*keep).mapInArrow(run, f"{schema}, fingerprint string")


def _edited(own: str, following: str) -> str:
    n = len(own) // 3
    return own[: len(own) - n] + following[:n]


def _results(ids: list, own: list[str], following: list[str], prints: np.ndarray, next_prints: np.ndarray) -> list[list]:
    edited = [_edited(a, b) for a, b in zip(own, following)]
    edited_prints = _all(edited)
    return [
        ids, [len(t) for t in own], [sha256(t.encode("utf-8")).hexdigest() for t in edited], [p.tobytes().hex() for p in prints], [p.tobytes().hex() for p in edited_prints],
        likeness(prints, edited_prints).tolist(), likeness(prints, next_prints).tolist(),
    ]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text, whose last third is the next document's beginning.

    Documents follow each other by descending doc_id, null last, then by text; the first follows the last.  Texts
    are dealt by ranges once; a range's last text meets the next range's first one afterwards, a row a range.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(F.desc_nulls_last("doc_id")).sortWithinPartitions(F.desc_nulls_last("doc_id"), "text")

    def run(batches):
        place = TaskContext.get().partitionId()

        def ends(kind: int, i, text: str) -> pa.RecordBatch:
            none = [pa.array([None], t) for t in _TYPES]
            none[0] = pa.array([i], pa.int64())
            return pa.RecordBatch.from_arrays([*none, pa.array([place], pa.int32()), pa.array([kind], pa.int32()), pa.array([text], pa.string())], names=[*_NAMES, "place", "kind", "text"])

        last = None  # the id and text of the row before, and its fingerprint
        for ids, texts in _parts(batches):
            prints = _all(texts)
            if last is None:
                yield ends(0, ids[0], texts[0])
            else:
                ids, texts, prints = [last[0], *ids], [last[1], *texts], np.concatenate([last[2], prints])
            last = ids[-1], texts[-1], prints[-1:]
            if len(ids) > 1:
                out = _results(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:])
                n = len(ids) - 1
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, _TYPES)), pa.array([place] * n, pa.int32()), pa.array([2] * n, pa.int32()), pa.nulls(n, pa.string())], names=[*_NAMES, "place", "kind", "text"])
        if last is not None:
            yield ends(1, last[0], last[1])

    made = cut(rows.mapInArrow(run, f"{_RESULT}, place int, kind int, text string"))
    heads = made.where("kind = 0").select("place", F.col("text").alias("following"))
    order = Window.orderBy("place")
    # One row a range, without texts.
    follows = made.where("kind = 0").select("place").withColumn("after", F.coalesce(F.lead("place").over(order), F.first("place").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    tails = made.where("kind = 1").select("place", "doc_id", "text").join(follows, "place").join(heads.withColumnRenamed("place", "after"), "after")

    def close(batches):
        for batch in batches:
            own, following = batch.column("text").to_pylist(), batch.column("following").to_pylist()
            out = _results(batch.column("doc_id").to_pylist(), own, following, _all(own), _all(following))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES)], names=_NAMES)

    return made.where("kind = 2").select(*_NAMES).unionByName(tails.select("doc_id", "text", "following").mapInArrow(close, _RESULT))


def _parts(batches, most: int = 2 << 20) -> Iterator[tuple[list, list[str]]]:
    """Runs of rows of a few megabytes."""
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        for at, chunk in string_chunks(texts, most):
            yield ids[at : at + len(chunk)], [chunk.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(chunk.at, chunk.at[1:])]
