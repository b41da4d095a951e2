"""Byte-level BPE: encoding by longest matches and backtracking, and decoding.

Bytes map to Latin-1 characters, so that pyahocorasick finds the longest vocabulary entry at every
place.  A run of tokens is the BPE encoding exactly when each neighbouring pair is one that the merges
leave apart; that test is memoised.  The longest matches of most pieces pass it at once, the others
are searched: the last token gives way to its next shorter prefix, and an end from which no token
continues is never tried again, so that each place of a piece is left once at most.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from hashlib import sha256
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import string_chunks

#: Entries of a cache before it is emptied; results do not depend on it.
CACHE = 200_000
_NONE = 1 << 60
#: No byte maps to this character.
_BETWEEN = chr(0x100)


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.tokens = {i: b for b, i in ranks.items()}
        self.width = {i: len(b) for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            if len(token) == 1 or self.merged(token) == [i]:
                self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        #: The longest entry that is a proper prefix of each entry.
        self.shorter = {i: self._prefix(b) for b, i in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}

    def merged(self, raw: bytes) -> list[int]:
        """The merges one by one; used on entries and pairs of entries, which are short."""
        ranks, parts = self.ranks, [raw[i : i + 1] for i in range(len(raw))]
        order = [ranks.get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
        while order and (best := min(order)) < _NONE:
            i = order.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del order[i]
            if i < len(order):
                order[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
            if i:
                order[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
        return [ranks[p] for p in parts]

    def apart(self, left: int, right: int) -> bool:
        """Whether the merges leave these two neighbours as they are."""
        if (known := self.pairs.get((left, right))) is None:
            if len(self.pairs) > 2 * CACHE:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def _prefix(self, raw: bytes) -> int | None:
        for n in range(len(raw) - 1, 0, -1):
            if (i := self.ranks.get(raw[:n])) is not None and self.automaton.exists(raw[:n].decode("latin-1")):
                return i
        return None

    def searched(self, latin: str, taken: list[int]) -> list[int]:
        """The encoding of a piece whose longest matches are ``taken``; neighbours are compatible up to some place."""
        pairs, width, shorter, longest = self.pairs, self.width, self.shorter, self.automaton.iter_long
        good, at, dead = 1, 0, bytearray(len(latin) + 1)
        while good < len(taken) and self.apart(taken[good - 1], taken[good]):
            good += 1
        if good == len(taken):
            return taken
        token = taken[good]
        del taken[good:]
        at = sum(width[t] for t in taken)
        while at < len(latin):
            last = taken[-1] if taken else None
            while token is not None:
                if not dead[at + width[token]]:
                    if last is None:
                        break
                    if (fits := pairs.get((last, token))) is None:
                        fits = self.apart(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token is None:
                dead[at] = 1
                token = taken.pop()
                at -= width[token]
                token = shorter[token]
                continue
            taken.append(token)
            at += width[token]
            if at < len(latin):
                token = next(longest(latin, at))[1]
        return taken

    def learn(self, new: list[str]) -> None:
        """Put the ids of these pieces, as little-endian 32-bit integers, into the cache."""
        rest, latins = [], []
        for piece in new:
            raw = piece.encode("utf-8")
            if (whole := self.ranks.get(raw)) is not None:
                self.pieces[piece] = whole.to_bytes(4, "little")
            else:
                rest.append(piece)
                latins.append(raw.decode("latin-1"))
        found: list[list[int]] = []
        bounds = iter(np.cumsum([len(x) + 1 for x in latins]).tolist())
        bound, now = -1, None
        for end, token in self.automaton.iter_long(_BETWEEN.join(latins)):
            if end >= bound:
                bound, now = next(bounds), []
                found.append(now)
            now.append(token)
        for piece, latin, ids in zip(rest, latins, found):
            if len(ids) > 1:
                ids = self.searched(latin, ids)
            self.pieces[piece] = pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = list(map(self.find, texts))
        known = self.pieces
        if len(known) > CACHE:
            known.clear()
        if new := {p for pieces in split for p in pieces if p not in known}:
            self.learn(list(new))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    with open(path, "rb") as f:
        return ByteBPE({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)


def _with(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name not in {x.name for x in fields}] + list(fields))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (little-endian unsigned 32-bit integers) and ``n_tokens`` to every row.

    A null or empty text has no tokens.  Columns called like the new ones are replaced.
    """
    keep = [c for c in df.columns if c not in (text, "ids", "n_tokens")]

    def run(batches):
        codec = load(path, pattern)
        for batch in batches:
            ids: list[bytes] = []
            for _, chunk in string_chunks(batch.column(text)):
                ids += codec.encode([chunk.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(chunk.at, chunk.at[1:])])
            columns = [batch.column(c) for c in keep] + [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "ids", "n_tokens"])

    schema = _with(df.select(*keep).schema, T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()))
    return df.select(*keep, text).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the bytes that the ids of every row stand for; null ids decode to no bytes."""
    keep = [c for c in df.columns if c != "decoded"]

    def run(batches):
        codec = load(path, pattern)
        for batch in batches:
            raw = [codec.decode(x or b"") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(raw, pa.binary())], names=[*keep, "decoded"])

    return df.select(*keep).mapInArrow(run, _with(df.select(*keep).schema, T.StructField("decoded", T.BinaryType())))


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """A row a document: its number of tokens, and the digests of its ids and of what they decode to.

    One worker encodes and decodes each text, and only digests leave it.
    """

    def run(batches):
        codec = load(path, pattern)
        for batch in batches:
            rows: list[tuple[int, str, str]] = []
            for _, chunk in string_chunks(batch.column("text")):
                for ids in codec.encode([chunk.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(chunk.at, chunk.at[1:])]):
                    rows.append((len(ids) // 4, sha256(ids).hexdigest(), sha256(codec.decode(ids)).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
