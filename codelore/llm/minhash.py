"""Near duplicates: universal hash minima, banding, verified links, and components by large-star and small-star.

Texts with the same set of shingles are one vertex.  A vertex has 130 minima of hashes over its shingles, the upper
halves of a x + b mod 2**64, in 26 bands of 5: two sets that share 0.85 of their union miss each other in all bands once
in four million.  In each bucket every member is compared with the smallest one; vertices so linked join components.
Buckets that still hold several components are compared across components in blocks of members, so that no link
between components is lost and no group is expanded into all pairs.  Signatures are compared first; texts are sent only
for pairs that are near by them, and every link is confirmed on the full sets.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Texts, cut, mixed, salted_lookup, string_chunks

SHINGLE, BANDS, ROWS = 5, 26, 5
#: Links share so many hundredths of their union.
PERCENT = 85
#: Share of equal minima from which a pair is confirmed on full sets; at 0.85 a pair has fewer once in 130 million.
LEAST_ALIKE = 0.65
#: Members of a bucket in a block that is compared as a whole, and pairs of a hub that meet its text in one task.
BLOCK, SPLIT = 96, 1024
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


@lru_cache(maxsize=1)
def _hashes() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(17)
    return tuple(draw.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64) for _ in range(2))


def shingle_sets(chunk: Texts) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    lower = Texts(_LOWER[chunk.data], chunk.at)
    starts, ends, of = lower.words()
    words = Rolling(lower.data).of(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    first = np.searchsorted(of, np.arange(len(chunk) + 1))
    n = len(words) - SHINGLE + 1
    runs = mixed(sum((words[k : k + n] * _MIX[k] for k in range(1, SHINGLE)), words[:n] * _MIX[0])) if n > 0 else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first, first[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a : b - SHINGLE + 1]))
        elif b > a:
            # The whole sequence as one shingle, told apart from others by its length.
            out.append(mixed((words[a:b] * _MIX[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of all hash functions over the shingles' upper halves, in blocks that bound the memory."""
    a, b = _hashes()
    x = shingles >> np.uint64(32)
    least = np.full(len(a), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(0, len(x), 2048):
        np.minimum(least, (x[None, k : k + 2048] * a + b).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    return mixed((mixed(rows * _MIX[None, :] + _MIX[None, ::-1])).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fp (a digest of the set), sig (a byte a minimum), bands (a key a band); from docs(doc_id, text).

    A text without words has no fp, and links with nothing.
    """

    def run(batches):
        for batch in batches:
            sizes, fps, sigs, keys = [], [], [], []
            for _, chunk in string_chunks(batch.column("text")):
                for s in shingle_sets(chunk):
                    sizes.append(len(s))
                    if not len(s):
                        fps.append(None), sigs.append(None), keys.append(None)
                        continue
                    least = signature(s)
                    # Two independent 64-bit sums over the set name it.
                    pair = np.array([s.sum(dtype=np.uint64), mixed(s ^ _MIX[1]).sum(dtype=np.uint64)], np.uint64)
                    fps.append(pair.tobytes() + len(s).to_bytes(4, "little"))
                    sigs.append(least.astype(np.uint8).tobytes())
                    keys.append(_band_keys(least))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "h", "n_shingles", "fp", "sig", "bands"]
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, h long, n_shingles long, fp binary, sig binary, bands array<long>")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The links among pairs(a, b, n): those whose full sets share enough.

    ``docs`` has a row an id of (doc_id, text, sig); ``n`` is how many partners ``a`` has at most in a bucket of the pair, so that
    one with many partners is dealt over tasks.
    """
    parts = F.ceil(F.col("n") / SPLIT).cast("int")
    spread = pairs.groupBy("a").agg(F.max(parts).alias("parts"))
    sides = docs.join(spread, docs["doc_id"] == spread["a"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sides = sides.select("a", "part", F.col("sig").alias("sig_a"), F.col("text").alias("text_a"))
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    signed = dealt.join(docs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b").join(sides.drop("text_a"), ["a", "part"])

    def near(batches):
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            alike = pa.array((one == two).mean(axis=1) >= LEAST_ALIKE) if batch.num_rows else pa.array([], pa.bool_())
            yield batch.select(["a", "b", "part"]).filter(alike)

    close = signed.select("a", "b", "part", "sig_a", "sig_b").mapInArrow(near, "a long, b long, part int")
    both = close.join(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(sides.drop("sig_a"), ["a", "part"])

    def run(batches):
        last, kept = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            found_a, found_b = [], []
            for k in range(0, len(a), 256):
                sets = [s for _, chunk in string_chunks(batch.column("text_b").slice(k, 256)) for s in shingle_sets(chunk)]
                for i, own in enumerate(sets, k):
                    if a[i] != last:
                        kept = next(shingle_sets(chunk)[0] for _, chunk in string_chunks(batch.column("text_a").slice(i, 1)))
                        last = a[i]
                    if _linked(kept, own):
                        found_a.append(a[i])
                        found_b.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every vertex of links(a, b) but the smallest of its component, which names it.

    Large-star links the larger neighbours of each vertex to its smallest, small-star the smaller ones and itself,
    in turn until every vertex has a single edge, to one that has none above it.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        ways = edges.union(edges.select("v", "u")) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # A vertex may have a third of all edges; after a large star none has so many above it.
        joined = salted_lookup(ways, least, "u", F.col("v"), 8) if large else ways.join(least, "u")
        if large:
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.where(F.col("u") != F.col("v")).distinct()

    def settled(edges: DataFrame) -> bool:
        ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()

    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct())
    while not settled(edges):
        edges = cut(star(star(edges, True), False))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of docs(doc_id, text).

    Rows without a doc_id take no part: they have no component and are kept.  Texts without words stand alone.
    Rows of one doc_id with different texts are documents of their own, with one name.  An empty table gives an empty one.
    """
    return labelled(docs).select("doc_id", "n_shingles", "component_id", "kept")


def labelled(docs: DataFrame) -> DataFrame:
    """The rows of ``near_duplicates`` with ``fp`` and ``h``, the fingerprint of the shingles and the hash of the text."""
    rows = cut(sketches(docs))
    linked = rows.where(F.col("doc_id").isNotNull() & F.col("fp").isNotNull())
    # A vertex has an id of its own, since rows of one doc_id may differ, and the text of its first row.
    vertex = linked.groupBy("fp").agg(F.min(F.struct("doc_id", "h", "sig", "bands")).alias("x"), F.count("*").alias("n"))
    vertex = cut(vertex.select("fp", "n", F.xxhash64("fp").alias("id"), F.col("x.doc_id").alias("first"), "x.h", "x.sig", "x.bands"))
    bands = vertex.select(F.col("id").alias("doc_id"), F.posexplode("bands").alias("band", "key")).select("doc_id", F.xxhash64("band", "key").alias("key"))
    hubs = bands.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where(F.col("n") > 1)
    full = cut(salted_lookup(bands, hubs, "key", F.col("doc_id"), 8).where(F.col("hub").isNotNull()))
    pairs = cut(full.where(F.col("doc_id") != F.col("hub")).groupBy(F.col("hub").alias("a"), F.col("doc_id").alias("b")).agg(F.max("n").alias("n")))
    ids = full.select("doc_id").distinct()
    own = vertex.select("id", F.col("first").alias("doc_id"), "h", "sig").join(ids.withColumnRenamed("doc_id", "id"), "id", "left_semi")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(own, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    texts = cut(texts.select(F.col("id").alias("doc_id"), "text", "sig"))
    links = cut(verified(pairs, texts))
    joined = components(links)

    more = cut(_across(full, joined, texts))
    if not more.isEmpty():
        joined = components(links.union(more))
    joined = joined.union(joined.select(F.col("component").alias("id"), "component").distinct())
    of = vertex.select("fp", "id", "first", "n").join(joined, "id", "left").where((F.col("n") > 1) | F.col("component").isNotNull()).withColumn("c", F.coalesce("component", "id"))
    # A component's name is its smallest doc_id; of several vertices with that doc_id one stays.
    names = of.groupBy("c").agg(F.min(F.struct("first", "fp")).alias("name"))
    labels = salted_lookup(of, names, "c", F.col("id")).select("fp", F.col("name.first").alias("component_id"), (F.col("fp") == F.col("name.fp")).alias("stays"))
    out = salted_lookup(rows.select("doc_id", "h", "n_shingles", "fp"), labels, "fp", F.col("doc_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    kept = (F.col("doc_id") == F.col("component_id")) & F.coalesce("stays", F.lit(True))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(kept, F.lit(True)).alias("kept"), "fp", "h")


def _across(full: DataFrame, joined: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between components whose members share a bucket.

    Buckets of several components are gathered by their largest one.  Its members, and those of all others that meet
    it, are dealt over blocks by hash; each pair of blocks is compared as a whole in one task, the largest component
    not with itself.  The signatures are compared first, and texts are sent to a pair of blocks only for members that
    are near another component's there.  One link a member and component is enough for what follows, so that the nearest
    pairs by signature are tried first and the rest only while none is a link.
    """
    members = full.join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("c"))
    sizes = members.groupBy("key", "c").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("key").agg(F.max(F.struct("n", "c"))["c"].alias("main"), F.count("*").alias("parts")).where(F.col("parts") > 1).drop("parts")
    dealt = cut(salted_lookup(members, open_, "key", F.col("doc_id"), 8).where(F.col("main").isNotNull()).select("main", "doc_id", "c").distinct())
    is_main = F.col("c") == F.col("main")
    # n_main blocks of the largest component, then n_rest blocks of the others.
    plan = dealt.groupBy("main").agg(F.ceil(F.count(F.when(is_main, 1)) / BLOCK).cast("int").alias("n_main"), F.ceil(F.count(F.when(~is_main, 1)) / BLOCK).cast("int").alias("n_rest"))
    dealt = salted_lookup(dealt, plan, "main", F.col("doc_id"))
    block = F.when(is_main, F.pmod(F.xxhash64("doc_id"), F.col("n_main"))).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("n_rest")) + F.col("n_main")).cast("int")
    others = F.sequence(F.col("n_main"), F.col("n_main") + F.col("n_rest") - 1)
    everything = F.sequence(F.lit(0), F.col("n_main") + F.col("n_rest") - 1)
    signed = dealt.withColumn("block", block).join(texts.select("doc_id", "sig"), "doc_id").withColumn("with", F.explode(F.when(is_main, others).otherwise(everything)))
    rows = signed.select("main", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "doc_id", "c", (F.col("block") == F.least("block", "with")).alias("first"), "sig")

    def sides(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        first = np.array(part.column("first").to_pylist(), bool)
        one, two = np.flatnonzero(first), np.flatnonzero(~first)
        return np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(len(first), -1), part.column("c").to_numpy(), one, two if len(two) else one

    def near(part: pa.Table) -> pa.Table:
        sig, c, one, two = sides(part)
        close = np.zeros(part.num_rows, bool)
        for i in two:
            hits = one[((sig[one] == sig[i]).mean(axis=1) >= LEAST_ALIKE) & (c[one] != c[i])]
            close[hits] = True
            close[i] |= len(hits) > 0
        return part.filter(pa.array(close))

    def compare(part: pa.Table) -> pa.Table:
        sig, c, one, two = sides(part)
        ids = part.column("doc_id").to_numpy()
        sets: list[np.ndarray] = []
        found_a, found_b = [], []
        # The smaller side asks, so that a member of the others looks for one link to each component.
        for i in two:
            alike = (sig[one] == sig[i]).mean(axis=1)
            near = np.flatnonzero((alike >= LEAST_ALIKE) & (c[one] != c[i]))
            linked: set[int] = set()
            for j in one[near[np.argsort(-alike[near], kind="stable")]].tolist():
                if int(c[j]) in linked:
                    continue
                if not sets:
                    sets = [s for _, chunk in string_chunks(part.column("text")) for s in shingle_sets(chunk)]
                if _linked(sets[i], sets[j]):
                    linked.add(int(c[j]))
                    found_a.append(min(int(ids[i]), int(ids[j])))
                    found_b.append(max(int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    pair = ("main", "low", "high")
    close = rows.groupBy(*pair).applyInArrow(near, rows.schema)
    return close.join(texts.select("doc_id", "text"), "doc_id").groupBy(*pair).applyInArrow(compare, "a long, b long")


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < PERCENT * large:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= PERCENT * (small + large - shared)
