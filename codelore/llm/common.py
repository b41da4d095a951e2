"""What several operators share: tables, durable cuts of lineage, hot-key lookups, words of whole texts."""

from __future__ import annotations

import ctypes
import ctypes.util
import re
import sys
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: the ASCII blanks, which never occur inside a UTF-8 sequence.
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the session names; one of our own only in local mode, where all share one disk."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def salted_lookup(rows: DataFrame, small: DataFrame, key: str, spread: Column, salts: int = 16) -> DataFrame:
    """Left join of rows to one row a key of ``small``, with each key dealt over ``salts`` tasks.

    A key that holds a third of all rows so meets its partner in many tasks.  ``small`` is repeated
    ``salts`` times, which grows with the number of keys, not with the rows.  Null keys match nothing.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    many = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", salt).join(many, [key, "_salt"], "left").drop("_salt")


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text divides by 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


class Texts:
    """Consecutive whole texts as one array of UTF-8 bytes; ``at[i]:at[i + 1]`` is text i."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at

    def __len__(self) -> int:
        return len(self.at) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every word."""
        solid = ~np.isin(self.data, BLANKS) if len(self.data) < 64 else _SOLID[self.data]
        before = np.empty(len(solid), bool)
        before[1:] = solid[:-1]
        before[self.at[:-1][self.at[:-1] < len(solid)]] = False
        after = np.empty(len(solid), bool)
        after[:-1] = solid[1:]
        after[self.at[1:][self.at[1:] > 0] - 1] = False
        starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        return starts, ends, np.searchsorted(self.at[1:], starts, "right")


_LIBC = ctypes.CDLL(name) if sys.platform == "linux" and (name := ctypes.util.find_library("c")) else None
_SOLID = np.ones(256, bool)
_SOLID[list(BLANKS)] = False


def string_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, Texts]]:
    """Runs of rows of about ``most`` bytes, the number of the first row with each; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, Texts(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j
    give_back()


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2**31, compressed: what a fit brings to the driver stays so until its turn comes."""
    return zlib.compress(numbers.astype("<i4").tobytes(), 1)


def unpacked(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), "<i4").reshape(rows, -1)


def give_back() -> None:
    """Return freed memory to the system, which a worker that outlives many tasks would else keep."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


class Rolling:
    """64-bit hashes of byte ranges: sums of tabled bytes times powers, arithmetic modulo 2**64."""

    STEP = np.uint64(0x9E3779B97F4A7C15)
    BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    _powers: dict[str, np.ndarray] = {}

    def __init__(self, data: np.ndarray, seed: int = 7):
        tabled = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
        n = len(data)
        self.back = self._table("back", self.BACK, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(tabled[data] * self._table("step", self.STEP, n + 1)[:n], out=self.sums[1:])

    @classmethod
    def _table(cls, name: str, base: np.uint64, n: int) -> np.ndarray:
        have = cls._powers.get(name)
        if have is None or len(have) < n:
            have = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
            have[0] = 1
            have = np.cumprod(have, dtype=np.uint64)
            if n <= CHUNK_BYTES + 1:
                cls._powers[name] = have
        return have

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))
