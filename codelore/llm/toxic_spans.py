"""A linear-chain conditional random field that tags toxic spans.

The states of a word are clean and toxic.  Its features are the hash of the lower-cased word without outer
punctuation and of its first 3 to 6 bytes; the neighbours count through the chain.  The weights of features and of steps between states
are learnt by gradient ascent from labelled words.  Labels come with documents, so that words are labelled first: in a
toxic document those with a feature that is far commoner in toxic than in clean documents, by more than
chance gives among so many features (a step-up test over all of them); all others are clean.  Forward and backward passes give each word's marginal; the largest is the document's score, and runs of
words of at least one half are the offending spans.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rolling, Texts, cut, give_back, mixed, packed, string_chunks, unpacked
from .subwords import labelled_sample

#: Words are many; with fewer buckets clean ones would share those of toxic ones.
BITS = 22
PREFIXES = (3, 4, 5, 6)
#: Most labelled rows of the clean and of the toxic class that a model is fitted on, and words in a training segment.
SAMPLE, SEGMENT = (2000, 1500), 60
#: How much commoner in toxic documents a feature that labels is, and the share of chance finds among such features.
RATIO, RATE = 12, 0.01
CHUNK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EDGE = np.zeros(256, bool)
_EDGE[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def word_features(chunk: Texts, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word, and a row of buckets for each of its own features.

    Bucket 0 stands for a feature that a word doesn't have.
    """
    lower = Texts(_LOWER[chunk.data], chunk.at)
    starts, ends, of = lower.words()
    a, b = starts.copy(), ends.copy()
    while len(at := np.flatnonzero((a < b) & _EDGE[lower.data[np.minimum(a, len(lower.data) - 1)]])) if len(a) else False:
        a[at] += 1
    while len(at := np.flatnonzero((a < b) & _EDGE[lower.data[b - 1]])) if len(a) else False:
        b[at] -= 1
    rolling, shift = Rolling(lower.data, 5), np.uint64(64 - bits)
    own = np.zeros((1 + len(PREFIXES), len(starts)), np.int64)
    own[0] = (rolling.of(a, b) >> shift).astype(np.int64)
    own[0, a == b] = 0
    for k, n in enumerate(PREFIXES, 1):
        at = np.flatnonzero(b - a >= n)
        own[k, at] = ((rolling.of(a[at], a[at] + n) ^ np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> shift).astype(np.int64)
    return starts, ends, of, own


def _chain(rates: np.ndarray, sizes: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Odds of toxic against clean that reach each word from those before it, times its own.

    ``rates`` holds the words' own odds, text after text; ``step[i, j]`` is the factor from state i to j, clean 0.
    All texts advance together while many are left; the longest ones end one by one.
    """
    out = np.empty(len(rates))
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    lengths = sizes[order]
    (cc, ct), (tc, tt) = step.tolist()
    if not len(rates):
        return out
    alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0])), "right")
    few = int(np.searchsorted(-alive, -12, "right")) if len(alive) else 0
    now = None
    for t in range(few):
        n = alive[t]
        at = starts[:n] + t
        now = rates[at] * ((now[:n] * tt + ct) / (now[:n] * tc + cc)) if t else rates[at] * (ct + tt) / (cc + tc)
        out[at] = now
    for k in range(int(np.searchsorted(-lengths, -few, "left"))):
        if few:
            odds = float(now[k])
            begin = few
        else:
            odds = float(rates[starts[k]]) * (ct + tt) / (cc + tc)
            out[starts[k]] = odds
            begin = 1
        values = []
        for r in rates[starts[k] + begin : starts[k] + lengths[k]].tolist():
            odds = r * ((odds * tt + ct) / (odds * tc + cc))
            values.append(odds)
        out[starts[k] + begin : starts[k] + lengths[k]] = values
    return out


def marginals(logits: np.ndarray, sizes: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Probability that each word is toxic; texts are runs of ``sizes`` words."""
    rates = np.exp(np.clip(logits, -40, 40))
    forward = _chain(rates, sizes, step)
    backward = _chain(rates[::-1], sizes[::-1], step.T)[::-1]
    odds = forward * backward / rates
    return odds / (1 + odds)


@dataclass
class Field:
    """Weights of all buckets and, last, the constant; with ``buckets``, ascending from 0, the weights of these alone."""

    weights: np.ndarray
    step: np.ndarray
    buckets: np.ndarray | None = None

    @cached_property
    def table(self) -> np.ndarray:
        """A weight for each of 2**BITS buckets, and the constant; made where texts are scored, so that it doesn't travel."""
        if self.buckets is None:
            return self.weights
        table = np.zeros((1 << BITS) + 1, self.weights.dtype)
        table[self.buckets], table[-1] = self.weights[:-1], self.weights[-1]
        return table

    def words(self, chunk: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, text number and marginal of every word."""
        starts, ends, of, own = word_features(chunk)
        weights = self.table
        logits = np.full(len(of), float(weights[-1]))
        for buckets in own:
            logits += weights[buckets]
        return starts, ends, of, marginals(logits, np.bincount(of, minlength=len(chunk)), self.step)


def copy_keys(own: np.ndarray) -> list[int]:
    """8 keys of a document's words; documents that share most runs of five words most likely agree in one of them.

    A key joins a pair of minima over the runs' hashes.
    """
    draw = np.random.default_rng(29)
    a, b = (draw.integers(1, 1 << 62, (16, 1), dtype=np.uint64) | np.uint64(1) for _ in range(2))
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
    words = own[0].astype(np.uint64)
    n = max(1, len(words) - 4)
    runs = sum((words[k : k + n] * odd[k] for k in range(min(5, len(words)))), np.zeros(1, np.uint64))
    least = np.full(16, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(0, len(runs), 4096):
        np.minimum(least, (runs[None, k : k + 4096] * a + b >> np.uint64(20)).min(axis=1), out=least)
    return mixed(least[0::2] * odd[0] + least[1::2] + np.arange(8, dtype=np.uint64)).astype(np.int64).tolist()


def without_copies(heads: list) -> list[int]:
    """The doc_ids of one of each label's sampled documents that share a key: a copy is no new evidence."""
    seen: set[tuple] = set()
    kept = []
    for r in sorted(heads, key=lambda r: r["doc_id"]):
        keys = {(r["label"], k) for k in r["keys"]}
        if not keys & seen:
            kept.append(r["doc_id"])
        seen |= keys
    return kept


def speaking(toxic: np.ndarray, both: np.ndarray, n: int, m: int, features: int) -> np.ndarray:
    """Which features label words of toxic documents as toxic, by the n toxic and m clean documents that have them.

    ``features`` is the number of all, of which rare ones may be left out.
    The share of toxic documents is 12 times that of clean ones, and the bound exp(-N KL(share, chance)) on so many
    toxic ones among its N documents passes the step-up test at a false discovery rate of one in a hundred over all features.
    """
    share, chance = toxic / both, n / (n + m)
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.nan_to_num(share * np.log(share / chance)) + np.nan_to_num((1 - share) * np.log((1 - share) / (1 - chance)))
    likely = ((toxic + 0.5) / (n + 1)) / ((both - toxic + 0.5) / (m + 1)) >= RATIO
    weight = np.where(share > chance, both * far, 0.0)
    ranked = np.sort(weight)[::-1]
    steps = np.flatnonzero(ranked >= np.log(features / (RATE * np.arange(1, len(weight) + 1))))
    least = ranked[steps[-1]] if len(steps) else np.inf
    return (weight >= least) & likely


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: tuple[int, int] = SAMPLE, epochs: int = 6, rate: float = 0.5, seed: int = 3) -> Field:
    """Fit on at most ``most`` labelled rows, by class.  Without words that speak, every word gets odds near nought.

    Whole texts of the sampled rows teach.  What reaches the driver is bounded by the number of these rows: their ids with 8
    keys each, the common features, of 2**BITS at most, and their words in segments.  Only common features have weights, by
    their rank among them: the driver never holds an array over all buckets.
    """
    sample, _ = labelled_sample(docs, labels, label, most)

    def run(batches):
        for batch in batches:
            out: list[bytes] = []
            keys: list[list[int]] = []
            for _, chunk in string_chunks(batch.column("text"), CHUNK >> 1):
                _, _, of, own = word_features(chunk)
                at = np.searchsorted(of, np.arange(len(chunk) + 1))
                out += [own[:, a:b].astype("<i4").tobytes() for a, b in zip(at, at[1:])]
                keys += [copy_keys(own[:, a:b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(keys, pa.list_(pa.int64())), pa.array(out, pa.binary())], names=["doc_id", "label", "keys", "own"])

    rows = cut(sample.mapInArrow(run, "doc_id long, label int, keys array<long>, own binary"))
    heads = rows.select("doc_id", "label", "keys").collect()
    alone = set(without_copies(heads))
    n = sum(r["label"] for r in heads if r["doc_id"] in alone)
    m = len(alone) - n
    none = Field(np.array([0.0, -9.0], np.float32), np.array([[0.98, 0.02], [0.6, 0.4]]), np.zeros(1, np.int64))
    if not n or not m:
        return none
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted(alone)], "doc_id long")
    rows = rows.join(F.broadcast(ids), "doc_id")

    def once(batches):
        for batch in batches:
            found = [np.unique(np.frombuffer(x, "<i4")) for x in batch.column("own").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.int32()))], names=["label", "buckets"])

    counts = rows.select("label", "own").mapInArrow(once, "label int, buckets array<int>").select("label", F.explode("buckets").alias("bucket"))
    counts = cut(counts.groupBy("bucket").agg(F.sum("label").alias("toxic"), F.count("*").alias("both")))
    # A feature of one document says nothing, however many there are.
    least = min(4, 1 + 0.01 * (n + m))
    known = counts.where((F.col("both") >= least) | (F.col("toxic") > 1)).toArrow()
    bucket, toxic, both = (known.column(c).to_numpy() for c in ("bucket", "toxic", "both"))
    speaks = bucket[speaking(toxic, both, n, m, counts.count())] if len(bucket) else bucket
    speaks = np.sort(speaks[speaks != 0])
    common = np.union1d(bucket[both >= least], [0])  # bucket 0 has rank 0
    del known, bucket, toxic, both
    give_back()
    if not len(speaks):
        return none
    marks = docs.sparkSession.sparkContext.broadcast((speaks, common))

    def cut_up(batches):
        speaks, common = marks.value
        for batch in batches:
            found: list[tuple] = []
            for i, is_toxic, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "own"))):
                own = np.frombuffer(raw, "<i4").reshape(1 + len(PREFIXES), -1)
                tags = np.isin(own, speaks).any(axis=0) & bool(is_toxic)
                rank = np.searchsorted(common, own, "right") - 1
                both = np.vstack([np.where(common[rank] == own, rank, 0), tags])
                # In toxic documents the words between labelled ones may be toxic too: only segments with a label teach.
                at = [k for k in range(0, own.shape[1], SEGMENT) if not is_toxic or tags[k : k + SEGMENT].any()]
                for k in at:
                    found.append((i, k, packed(both[:, k : k + SEGMENT])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 3, (pa.int64(), pa.int32(), pa.binary()))], names=["doc_id", "at", "segment"])

    segments = rows.select("doc_id", "label", "own").mapInArrow(cut_up, "doc_id long, at int, segment binary").toArrow()
    order = np.lexsort((segments.column("at").to_numpy(), segments.column("doc_id").to_numpy()))
    kept = segments.column("segment").to_pylist()
    del segments
    give_back()
    kept = [kept[i] for i in order]
    weights, step = trained(kept, len(common), epochs, rate, seed)
    del kept
    give_back()
    return Field(weights, step, common)


def trained(kept: list[bytes], n: int, epochs: int = 6, rate: float = 0.5, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Gradient ascent on packed segments, the ranks (below n) of features and a row of tags: the weights and the constant, and the steps."""
    weights = np.zeros(n + 1, np.float32)
    step = np.array([[0.98, 0.02], [0.6, 0.4]])
    # What a word without known features gets stays: learnt, it would rise while the known clean words fall.
    weights[-1] = -6.0
    draw = np.random.default_rng(seed)
    seen, moved = np.full(len(weights), 1e-3, np.float32), np.log(step)
    # A small sample gives few steps an epoch: at least 120 in all.
    for _ in range(max(epochs, -(-120 * 512 // len(kept)))):
        order = draw.permutation(len(kept))
        for k in range(0, len(order), 512):
            part = [unpacked(kept[i], 2 + len(PREFIXES)) for i in order[k : k + 512]]
            sizes = np.array([p.shape[1] for p in part])
            *ranks, tags = np.concatenate(part, axis=1)
            ranks, tags = np.stack(ranks), tags.astype(np.float64)
            of = np.repeat(np.arange(len(part)), sizes)
            step = np.exp(moved)
            step /= step.sum(axis=1, keepdims=True)
            p = marginals(weights[-1] + weights[ranks].sum(axis=0, dtype=np.float64), sizes, step)
            slope = tags - p
            used, place = np.unique(ranks, return_inverse=True)
            change = np.bincount(place.ravel(), np.tile(slope, len(ranks)))
            change[used == 0] = 0
            change -= 1e-3 * weights[used]
            seen[used] += change**2
            weights[used] += rate * change / np.sqrt(seen[used])
            # Steps follow the tagged pairs and the pairs that the marginals expect.
            inner = of[1:] == of[:-1]
            for i, (a, pa_) in enumerate(((1 - tags, 1 - p), (tags, p))):
                for j, (b, pb) in enumerate(((1 - tags, 1 - p), (tags, p))):
                    moved[i, j] += 0.02 * float(((a[:-1] * b[1:]) - (pa_[:-1] * pb[1:]))[inner].mean())
    step = np.exp(moved)
    return weights, step / step.sum(axis=1, keepdims=True)


def tag(df: DataFrame, field: Field, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add ``score``, ``predicted`` and ``spans``, an array of (start, end, score) in code points.

    A null or empty text has score 0 and no spans.  Only the text counts.
    """
    shared = df.sparkSession.sparkContext.broadcast(field)
    keep = [c for c in df.columns if c not in ("score", "predicted", "spans")]
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches):
        own = shared.value
        for batch in batches:
            scores: list[np.ndarray] = []
            spans: list[list] = []
            for _, chunk in string_chunks(batch.column(text), CHUNK):
                starts, ends, of, p = own.words(chunk)
                best = np.zeros(len(chunk))
                np.maximum.at(best, of, p)
                scores.append(np.minimum(best, 1.0))
                found: list[list] = [[] for _ in range(len(chunk))]
                if len(hits := np.flatnonzero(p >= threshold)):
                    points = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
                    for run_ in np.split(hits, np.flatnonzero((np.diff(hits) > 1) | (np.diff(of[hits]) > 0)) + 1):
                        a, b, i = run_[0], run_[-1], of[run_[0]]
                        zero = points[chunk.at[i]]
                        found[i].append({"start": int(points[starts[a]] - zero), "end": int(points[ends[b]] - zero), "score": float(p[run_].max())})
                spans += found
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(spans, pa.list_(span))], names=[*keep, "score", "spans"])

    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("spans", kind)])
    return df.select(*keep).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
