"""Cross-tokenizer alignment in Arrow columns.

Two vocabularies cut the same bytes, space and text, into tokens.  A batch of texts becomes two flat columns of ids with
parent indices; segmented cumulative sums of the tokens' lengths give the byte at which each ends in its document, and an
Acero hash join on (document, end) finds where tokens of both end together.  These places cut a document into groups, and
the last tokens of a group are linked.  ``Table.group_by`` counts linked id pairs of a batch, and Spark adds the counts up.

Of two tokens that end together the shorter is a suffix of the longer one.  So the pairs that any corpus can link are no
more than ``pair_bound``, the pairs of entries of which one ends in the other (some hundred thousand for vocabularies of
tens of thousands): the table of counts is as bounded as the vocabularies, and is broadcast.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut, string_chunks

#: Blanks in a row on which the quick library's pattern may run out of stack; such texts go to the other one.
BLANK_RUN = re.compile(r"\s{1000}")
#: Links that are looked up at once.
LINKS = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 itself, the rest from 256 on."""
    own = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


@dataclass
class Vocabulary:
    entries: list[bytes]
    #: The same by id, as columns: bytes, their lengths, ids in decimal.
    raw: pa.Array
    width: pa.Array
    name: pa.Array

    @classmethod
    def of(cls, entries: list[bytes]) -> Vocabulary:
        return cls(entries, pa.array(entries, pa.large_binary()), pa.array(list(map(len, entries)), pa.int64()), pa.array(list(map(str, range(len(entries)))), pa.large_string()))


class Aligner:
    """Both vocabularies; ``pairs`` are coded as a * size + b."""

    def __init__(self, bytes_path: str, pieces_path: str, pattern: str):
        with open(bytes_path, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        # Another thread or fork of this process has no part in it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_file(bytes_path)
        self.slow.encode_special_tokens = True
        self.slow.no_truncation()
        self.slow.no_padding()
        alphabet, special = byte_alphabet(), {t.content for t in self.slow.get_added_tokens_decoder().values()}
        ranks = {bytes(map(alphabet.__getitem__, w)): i for w, i in entries.items() if w not in special}
        by_id = {i: b for b, i in ranks.items()}
        self.a = Vocabulary.of([by_id.get(i, b"") for i in range(self.slow.get_vocab_size())])
        # Ids in the order of the merges are ranks, by which the quick library merges.
        self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        p = self.pieces
        self.b = Vocabulary.of([bytes([int(p.id_to_piece(i)[3:-1], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in range(p.get_piece_size())])
        self.size = len(self.b.entries)

    def pair_bound(self) -> int:
        """How many pairs of entries there are of which one ends in the other."""
        ids: list[dict[bytes, int]] = [defaultdict(int), defaultdict(int)]
        for held, vocabulary in zip(ids, (self.a, self.b)):
            for entry in vocabulary.entries:
                held[entry] += 1
        longer = sum(ids[1].get(e[i:], 0) for e in self.a.entries for i in range(len(e)))
        return longer + sum(ids[0].get(e[i:], 0) for e in self.b.entries for i in range(1, len(e)))

    def encoded(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        """The ids of every text by both vocabularies, as two columns of lists; an empty text has none."""
        a = [_NO_IDS if not t else np.array(self.slow.encode(" " + t, add_special_tokens=False).ids, np.uint32) if BLANK_RUN.search(t) else self.quick.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]
        b = self.pieces.encode(texts, num_threads=1) if texts else []
        ends = np.cumsum([0, *map(len, a)])
        return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([_NO_IDS, *a]).astype(np.int64))), pa.array([i if t else [] for t, i in zip(texts, b)], pa.large_list(pa.int64()))


_NO_IDS = np.zeros(0, np.uint32)


@lru_cache(maxsize=1)
def load(bytes_path: str, pieces_path: str, pattern: str) -> Aligner:
    return Aligner(bytes_path, pieces_path, pattern)


def joined_bytes(lists: pa.Array, vocabulary: Vocabulary) -> pa.Array:
    """The bytes of each list's tokens in a row."""
    return pc.binary_join(pa.LargeListArray.from_arrays(lists.offsets, vocabulary.raw.take(lists.flatten())), pa.scalar(b"", pa.large_binary()))


def token_ends(lists: pa.Array, vocabulary: Vocabulary) -> pa.Table:
    """A row a token: its document, the byte at which it ends there, its place in the flat column, its id."""
    ids, parent = lists.flatten(), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(vocabulary.width.take(ids))
    # What all documents before have of the running sum is taken off.
    before = pa.concat_arrays([pa.array([0], pa.int64()), total]).take(lists.offsets)
    return pa.table({"doc": parent, "end": pc.subtract(total, before.take(parent)), "at": pa.array(np.arange(len(ids))), "id": ids})


def common_ends(a: pa.Table, b: pa.Table) -> pa.Table:
    """The places at which tokens of both end, in order: doc, and place and id of either token."""
    both = a.rename_columns(["doc", "end", "at_a", "a"]).join(b.rename_columns(["doc", "end", "at_b", "b"]), ["doc", "end"], join_type="inner", use_threads=False)
    return both.select(["doc", "at_a", "at_b", "a", "b"]).sort_by("at_a").combine_chunks()


def _runs(last: pa.ChunkedArray) -> pa.Array:
    """Offsets of runs that tile a column, from the place at which each ends."""
    return pa.array(np.concatenate([[0], last.to_numpy() + 1]), pa.int64())


def group_texts(shared: pa.Table, a: pa.Array, b: pa.Array, docs: int, x: Vocabulary, y: Vocabulary) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of every document."""
    sides = [pc.binary_join(pa.LargeListArray.from_arrays(_runs(shared[at]), v.name.take(ids)), pa.scalar(",", pa.large_string())) for at, ids, v in (("at_a", a, x), ("at_b", b, y))]
    groups = pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string()))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(_offsets(shared, docs), pa.int64()), groups), pa.scalar(";", pa.large_string())).to_pylist()


def _offsets(shared: pa.Table, docs: int) -> np.ndarray:
    return np.searchsorted(shared["doc"].to_numpy(), np.arange(docs + 1))


def align(docs: DataFrame, bytes_path: str, pieces_path: str, pattern: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links`` of every row of docs(doc_id, text).

    ``links`` holds the linked id pairs in their order, each as a * size of the pieces' vocabulary + b.  A text that is null
    or empty, or that either vocabulary doesn't give back byte by byte with a space before it, has no tokens: zeros, no links,
    and '' for the digest.  Repeated rows and rows without a doc_id are rows like others; other columns of docs take no part.
    """

    def run(batches):
        own = load(bytes_path, pieces_path, pattern)
        for batch in batches:
            done = []
            for at, chunk in string_chunks(batch.column("text")):
                raw = [chunk.data[i:j].tobytes() for i, j in zip(chunk.at, chunk.at[1:])]
                a, b = own.encoded([x.decode("utf-8", "replace") for x in raw])
                want = pa.array([b" " + x if x else b"" for x in raw], pa.large_binary())
                good = pc.and_(pc.equal(joined_bytes(a, own.a), want), pc.equal(joined_bytes(b, own.b), want))
                if not pc.all(good).as_py():
                    nothing = pa.scalar([], a.type)
                    a, b = pc.if_else(good, a, nothing), pc.if_else(good, b, nothing)
                shared = common_ends(token_ends(a, own.a), token_ends(b, own.b))
                texts = group_texts(shared, a.flatten(), b.flatten(), len(chunk), own.a, own.b)
                n_a, n_b = pc.list_value_length(a), pc.list_value_length(b)
                offsets = _offsets(shared, len(chunk))
                codes = pc.add(pc.multiply(shared["a"], own.size), shared["b"]).combine_chunks()
                n = pa.array(np.diff(offsets), pa.int64())
                digests = pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts])
                done.append(pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(chunk)), n_a, n_b, n, n, digests, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), codes)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]))
            yield from done

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n``: how often each pair is linked over all rows; counted by batch first."""

    def run(batches):
        for batch in batches:
            links = batch.column("links")
            for at in range(0, batch.num_rows, 1024):
                part = pa.table({"pair": links.slice(at, 1024).flatten()})
                yield from part.group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "n"]).to_batches()

    return aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def with_counts(aligned: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """Add ``n_best`` (links whose count is the highest of their second id, ties too) and ``count_sum`` (over links).

    ``counts`` has no more rows than ``pair_bound``, so that it is broadcast.
    """
    table = counts.toArrow()
    pairs, n = table["pair"].to_numpy().astype(np.int64), table["n"].to_numpy().astype(np.int64)
    order = np.argsort(pairs)
    most = np.zeros(size, np.int64)
    np.maximum.at(most, pairs % size, n)
    shared = aligned.sparkSession.sparkContext.broadcast((pairs[order], n[order], (n == most[pairs % size])[order]))
    keep = [c for c in aligned.columns if c not in ("n_best", "count_sum")]

    def run(batches):
        known, times, best = map(pa.array, shared.value)
        best = best.cast(pa.int64())
        for batch in batches:
            links = batch.column("links")
            ends = links.offsets.to_numpy().astype(np.int64)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + LINKS, "right")) - 1)
                place = pc.index_in(links.slice(at, to - at).flatten(), value_set=known)
                sums = []
                for values in (best, times):
                    total = np.concatenate([[0], pc.cumulative_sum(values.take(place)).to_numpy()])
                    sums.append(pa.array(np.diff(total[ends[at : to + 1] - ends[at]]), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(at, to - at) for c in keep] + sums, names=[*keep, "n_best", "count_sum"])
                at = to

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.select(*keep).schema.fields)
    return aligned.select(*keep).mapInArrow(run, f"{schema}, n_best long, count_sum long")


def align_corpus(docs: DataFrame, bytes_path: str, pieces_path: str, pattern: str) -> DataFrame:
    """The rows of ``align`` with ``n_best`` and ``count_sum``.  An empty table gives an empty one."""
    aligned = cut(align(docs, bytes_path, pieces_path, pattern))
    return with_counts(aligned, pair_counts(aligned), load(bytes_path, pieces_path, pattern).size)
