"""Supervised subword embeddings: hashed words and character n-grams, averaged and put through a softmax.

Every word, every run of 3 to 5 bytes inside a word and its borders, and a mark for each word that repeats the
word before it has a learned vector, found by hash.  A document is the mean of its vectors; a linear layer
and a softmax give the classes.  Stochastic gradient descent in numpy fits vectors and layer on a
bounded sample of labelled rows; scoring covers every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rolling, Texts, give_back, held_out, packed, string_chunks, unpacked

GRAMS = (3, 4, 5)
BITS = 17
#: Most labelled rows of each class that a model is fitted on.
SAMPLE = (1000, 1000)
#: Bytes of text that are turned into features at once; an n-gram takes some 150 bytes meanwhile.
CHUNK = 1 << 18


def features(chunk: Texts, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every feature of these texts."""
    shift = np.uint64(64 - bits)
    starts, ends, of = chunk.words()
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rolling = Rolling(chunk.data)
    words = rolling.of(starts, ends)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    buckets = [(words >> shift).astype(np.int64), np.full(int(again.sum()), 1, np.int64)]
    texts = [of, of[again]]
    solid = np.zeros(len(chunk.data) + 1, np.int32)
    blank = np.ones(len(chunk.data), bool)
    word_of = np.repeat(np.arange(len(starts)), ends - starts)
    inside = np.repeat(starts - np.concatenate([[0], np.cumsum(ends - starts)[:-1]]), ends - starts) + np.arange(len(word_of))
    blank[inside] = False
    np.cumsum(blank, out=solid[1:])
    text_of = np.repeat(np.arange(len(chunk)), np.diff(chunk.at))
    for n in GRAMS:
        if len(chunk.data) < n:
            continue
        last = len(chunk.data) - n + 1
        at = np.flatnonzero((solid[n - 1 : n - 1 + last] == solid[1 : 1 + last]) & (text_of[:last] == text_of[n - 1 :]))
        grams = rolling.of(at, at + n) + np.uint64(n)
        buckets.append((grams >> shift).astype(np.int64))
        texts.append(text_of[at])
    return np.concatenate(buckets), np.concatenate(texts)


@dataclass
class Model:
    """The fitted network, folded: a bucket's share of the difference of the two logits, and its constant."""

    weights: np.ndarray
    bias: float

    def scores(self, chunk: Texts) -> np.ndarray:
        buckets, texts = features(chunk)
        total = np.bincount(texts, self.weights[buckets], len(chunk))
        count = np.bincount(texts, minlength=len(chunk))
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: tuple[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """At most so many labelled ids of class 0 and 1, in the order of a hash, with a text each; and the class counts.

    Held-out rows never take part.  The sampled ids are at most ``sum(most)`` rows, so that their broadcast is bounded.
    Of several rows of one doc_id the text with the smallest hash counts; null counts as empty.
    """
    open_ = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {int(r["label"]): r["count"] for r in open_.groupBy("label").count().collect()}
    ids = None
    for value in (0, 1):
        part = open_.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[value])
        ids = part if ids is None else ids.union(part)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text")), counts


def fit(docs: DataFrame, labels: DataFrame, label: str, most: tuple[int, int] = SAMPLE, dim: int = 10, epochs: int = 5, rate: float = 0.3, layer_rate: float = 0.1, seed: int = 11) -> Model:
    """Fit on the sample, whose texts teach as a whole: at most 2**BITS features a row.  With fewer than two classes the constant that the labels give, 0.5 without any."""
    sample, counts = labelled_sample(docs, labels, label, most)

    def run(batches):
        for batch in batches:
            out: list[bytes] = []
            for _, chunk in string_chunks(batch.column("text"), CHUNK):
                buckets, texts = features(chunk)
                for i in range(len(chunk)):
                    ids, n = np.unique(buckets[texts == i], return_counts=True)
                    out.append(packed(np.stack([np.diff(ids, prepend=0), n])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(out, pa.binary())], names=["doc_id", "label", "counts"])

    rows = sample.mapInArrow(run, "doc_id long, label int, counts binary").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy())
    labelled, kept = ([x[i] for i in order] for x in (rows.column(c).to_pylist() for c in ("label", "counts")))
    del rows
    give_back()
    prior = np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5))
    kinds = set(labelled)
    if len(kinds) < 2:
        return Model(np.zeros(1 << BITS), float(prior) if kinds else 0.0)
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    layer, bias = draw.uniform(-1, 1, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    share = sum(labelled) / len(labelled)
    weight = np.array([0.5 / (1 - share), 0.5 / share], np.float32)
    step, steps = 0, epochs * len(kept)
    for _ in range(epochs):
        for i in draw.permutation(len(kept)):
            (gaps, n), y = unpacked(kept[i], 2), labelled[i]
            ids, part = np.cumsum(gaps), (n / max(n.sum(), 1)).astype(np.float32)
            now = (1 - step / steps) * weight[y]
            step += 1
            hidden = part @ vectors[ids]
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            back = layer @ p
            layer -= now * layer_rate * np.outer(hidden, p)
            bias -= now * layer_rate * 0.1 * p
            # A mean spreads its gradient over many vectors; scaled so that each text moves its own mean alike.
            vectors[ids] -= (now * rate / max(float(part @ part), 1e-6)) * np.outer(part, back)
    del kept
    give_back()
    # The sample is balanced by weights: the classes' own shares shift the constant.
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0] + prior))


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add ``score``, the probability of class 1, and ``predicted``.

    Null and empty texts have no features and get the model's constant.  Only the text counts.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in df.columns if c not in ("score", "predicted")]

    def run(batches):
        own = shared.value
        for batch in batches:
            parts = [own.scores(chunk) for _, chunk in string_chunks(batch.column(text), CHUNK)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.concatenate(parts) if parts else [], pa.float64())], names=[*keep, "score"])

    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("score", T.DoubleType())])
    return df.select(*keep).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
