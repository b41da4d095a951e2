"""N-gram Jaccard self-join by partitioning the universe of shingles; exact.

Two sets of r and s shingles that share p hundredths of their union differ in at most h = (r + s)(100 - p) / (100 + p)
shingles.  Hashing deals the universe into segments, so many that a set has about six shingles in each; the number is fixed
by a band of sizes.  A set owns units: each segment's subset as a key (one unit), and for some segments, the deep ones, also
the subset with each one shingle left out (one more unit).  By the pigeonhole principle, sets that differ in at most h
shingles agree in a unit of any h + 1 units of the larger one: they have a segment in which they don't differ, or a deep one
in which they differ by one.

Cost-based allocation: all keys are counted first, and each set asks with the h + 1 units whose keys are rarest, as its
partition has more units than that; with the rest it only answers.  So an empty segment, or one that holds nothing but a
common line, leads to few candidates.  A set asks in its own band of sizes, and in the band below where it may have partners.

Sets that share a key are first compared with the one among them that shares its keys with the most others, the hub: in a
group of copies that is one near their common origin, to which they are nearer than to each other.  What then lies in several
components is compared in blocks.  Candidates must pass a lower bound of their difference, the sum of differences of shingle counts by segment, before
texts are sent; full sets confirm every link.  Nothing here loses a link but for equal 64-bit hashes of different shingles or sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import Rolling, Texts, cut, mixed, salted_lookup, string_chunks
from .minhash import components

SHINGLE, PERCENT = 4, 85
#: Largest over smallest size of a band, and of how many segments one is deep.
RATIO, DEEP = 1.6, 48
#: Members of a block whose sketches are compared as a whole, texts of each side in one task, and pairs of a hub that meet
#: its text in one task.
BLOCK, TEXTS, SPLIT = 512, 96, 1024
#: Keys that a task holds before it sends them, and rows of one key that it holds before it takes the key as shared.
SENT, HELD = 1 << 18, 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.random.default_rng(29).integers(1 << 62, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def most_apart(total: int) -> int:
    """In how many shingles linked sets differ at most whose sizes add up to ``total``."""
    return total * (100 - PERCENT) // (100 + PERCENT)


def _lows() -> np.ndarray:
    lows = [1]
    while lows[-1] < 1 << 40:
        lows.append(max(lows[-1] + 1, int(lows[-1] * RATIO)))
    return np.array(lows)


LOWS = _lows()


def band_of(n: int) -> int:
    return int(np.searchsorted(LOWS, n, "right")) - 1


def plan(band: int) -> tuple[int, int]:
    """Segments of a band, and how many of them are deep; none where linked sets are equal."""
    largest = int(LOWS[band + 1]) - 1
    apart = most_apart(largest + 100 * largest // PERCENT)
    return (apart + 1, -(-(apart + 1) // DEEP)) if apart else (0, 0)


def roles(n: int) -> list[tuple[int, bool, int]]:
    """(band, guest, spare units) of a set: where it stands, and the band below if it may have partners there."""
    home, out = band_of(n), []
    for band, guest in ((home, False), (home - 1, True)):
        if band < 0:
            continue
        segments, deep = plan(band)
        partner = min(n, int(LOWS[band + 1]) - 1)
        if segments and 100 * partner >= PERCENT * n:
            out.append((band, guest, segments + deep - most_apart(n + partner) - 1))
    return out


def shingle_sets(chunk: Texts) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    lower = Texts(_LOWER[chunk.data], chunk.at)
    starts, ends, of = lower.words()
    words = Rolling(lower.data, 11).of(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    first = np.searchsorted(of, np.arange(len(chunk) + 1))
    n = len(words) - SHINGLE + 1
    runs = mixed(sum((words[k : k + n] * _ODD[k] for k in range(1, SHINGLE)), words[:n] * _ODD[0])) if n > 0 else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first, first[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a : b - SHINGLE + 1]))
        elif b > a:
            # The whole sequence as one shingle, told apart from others by its length.
            out.append(mixed((words[a:b] * _ODD[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit digest of a set, by which copies are one."""
    return int(mixed(s ^ _ODD[5]).sum(keepdims=True, dtype=np.uint64).view(np.int64)[0]) ^ len(s)


def _segments(s: np.ndarray, m: int) -> np.ndarray:
    """Segments of sorted hashes: shares of their upper halves, so that a segment is a run."""
    return ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)


def units(s: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a set in a band with the segment of each, whether one shingle is left out, and whether the unit is spare.

    A deep segment's full subset is never spared, since sparing its deletions alone gives back one unit.
    """
    m, deep = plan(band)
    seg = _segments(s, m)
    at = np.searchsorted(seg, np.arange(m + 1, dtype=np.uint64))
    one = mixed(s ^ _ODD[7])
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(one, dtype=np.uint64)])
    sums = before[at[1:]] - before[at[:-1]]
    tag = mixed(np.arange(m, dtype=np.uint64) * _ODD[3] + np.arange(band + 1, band + 2, dtype=np.uint64) * _ODD[4])
    in_deep = int(at[deep])
    where = seg[:in_deep].astype(np.int64)
    keys = np.concatenate([mixed(sums + tag), mixed(sums[where] - one[:in_deep] + tag[where])])
    segments = np.concatenate([np.arange(m), where])
    left_out = np.arange(len(keys)) >= m
    return keys.view(np.int64), segments, left_out, left_out | (segments >= deep)


def sketch(s: np.ndarray) -> bytes:
    """Shingle counts by segment, of a power of two segments with six shingles or fewer in the mean."""
    width = 8
    while width * 6 < len(s):
        width *= 2
    return np.minimum(np.bincount(_segments(s, width).astype(np.int64), minlength=width), 255).astype(np.uint8).tobytes()


def folded(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(width, -1).sum(axis=1, dtype=np.int32)


def apart(n_a: int, a: bytes, n_b: int, b: bytes) -> int | None:
    """A lower bound of the number of shingles in which two sets differ; None if they can't be linked.

    Sizes too far apart can't, nor can counts by segment that differ too much.
    """
    if 100 * min(n_a, n_b) < PERCENT * max(n_a, n_b):
        return None
    width = min(len(a), len(b))
    least = int(np.abs(folded(a, width) - folded(b, width)).sum())
    return least if least <= most_apart(n_a + n_b) else None


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < PERCENT * large:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= PERCENT * (small + large - shared)


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, h, n_shingles, id, sketch`` of docs(doc_id, text, h); a text without words has no id."""

    def run(batches):
        for batch in batches:
            n, ids, sketches = [], [], []
            for _, chunk in string_chunks(batch.column("text")):
                for s in shingle_sets(chunk):
                    n.append(len(s))
                    ids.append(set_id(s) if len(s) else None)
                    sketches.append(sketch(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(sketches, pa.binary())], names=["doc_id", "h", "n_shingles", "id", "sketch"])

    return docs.select("doc_id", "text", "h").mapInArrow(run, "doc_id long, h long, n_shingles long, id long, sketch binary")


#: Fields of a key's ``info``: spare units of the set (24 bits), segment (24), spare, left out, guest, band.
_SEGMENT, _SPARE, _LEFT, _GUEST, _BAND = 24, 48, 49, 50, 51


def keys(docs: DataFrame) -> DataFrame:
    """``key, id, info`` of every unit of every set of docs(text); a task leaves out copies of sets that it has had."""

    def run(batches):
        had: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0
        for batch in batches:
            for _, chunk in string_chunks(batch.column("text")):
                for s in shingle_sets(chunk):
                    if not len(s) or (name := set_id(s)) in had:
                        continue
                    had.add(name)
                    for band, guest, spare in roles(len(s)):
                        key, segments, left_out, may = units(s, band)
                        info = (segments << _SEGMENT) | (may.astype(np.int64) << _SPARE) | (left_out.astype(np.int64) << _LEFT) | (int(guest) << _GUEST) | (band << _BAND) | spare
                        held.append((key, np.full(len(key), name), info))
                        count += len(key)
                    if count >= SENT:
                        yield _batch(held)
                        held, count = [], 0
        if held:
            yield _batch(held)

    return docs.select("text").mapInArrow(run, "key long, id long, info long")


def _batch(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=["key", "id", "info"])


def _bits(at: int, width: int = 1) -> Column:
    return F.shiftright("info", at).bitwiseAND((1 << width) - 1)


def _shared(batches):
    """From rows sorted by (key, id, info), those of keys that two sets hold, one at home and one whole, with the number of rows.

    A key at the end of a partition may go on in the next one, and a long run is sent in pieces: both count as shared,
    and their number as what was seen of them.
    """
    key, id_, info = (np.zeros(0, np.int64) for _ in range(3))
    sure = True
    for batch in batches:
        key, id_, info = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in ((key, "key"), (id_, "id"), (info, "info")))
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        done = len(key) if len(key) - last > HELD else last
        if done:
            yield from _live(key[:done], id_[:done], info[:done], sure, done > last)
            sure = done > last
            key, id_, info = key[done:], id_[done:], info[done:]
    if len(key):
        yield from _live(key, id_, info, True, True)


def _live(key, id_, info, first: bool, last: bool):
    """Shared keys of whole runs; ``first`` and ``last`` tell whether the runs at the ends count as shared anyhow."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (id_[1:] != id_[:-1]) | (info[1:] != info[:-1])
    key, id_, info = key[new], id_[new], info[new]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.append(start, len(key)))
    several = np.minimum.reduceat(id_, start) != np.maximum.reduceat(id_, start)
    live = several & (np.minimum.reduceat(info >> _LEFT & 1, start) == 0) & (np.minimum.reduceat(info >> _GUEST & 1, start) == 0)
    live[0] |= first
    live[-1] |= last
    keep = np.repeat(live, n)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[keep], id_[keep], info[keep], np.repeat(n, n)[keep])], names=["key", "id", "info", "n"])


def shared_keys(docs: DataFrame) -> DataFrame:
    """``key, id, asks, n``: the keys that several sets hold, with all who hold them, whether the set asks with the key, and
    how many rows of the key were seen together.

    Ranges of (key, id) deal the keys out, so that one which many sets hold is spread over tasks.
    """
    ordered = keys(docs).repartitionByRange("key", "id").sortWithinPartitions("key", "id", "info")
    found = cut(ordered.mapInArrow(_shared, "key long, id long, info long, n long"))
    part = F.shiftright("info", _GUEST)
    costs = found.where(_bits(_SPARE) == 1).groupBy("id", part.alias("part"), _bits(_LEFT).alias("left_out"), _bits(_SEGMENT, 24).alias("segment"), _bits(0, 24).alias("spare")).agg(F.sum("n").alias("cost"))
    rank = F.row_number().over(Window.partitionBy("id", "part").orderBy(F.desc("cost"), "left_out", "segment"))
    spared = costs.withColumn("rank", rank).where(F.col("rank") <= F.col("spare")).select("id", "part", "left_out", "segment", F.lit(False).alias("kept"))
    units_ = found.select("key", "id", part.alias("part"), _bits(_LEFT).alias("left_out"), _bits(_SEGMENT, 24).alias("segment"), "n")
    asking = units_.join(spared, ["id", "part", "left_out", "segment"], "left").select("key", "id", F.coalesce("kept", F.lit(True)).alias("asks"), "n")
    return asking.groupBy("key", "id").agg(F.max("asks").alias("asks"), F.max("n").alias("n"))


def hub_pairs(full: DataFrame) -> DataFrame:
    """``a, b``: each set b that holds a key which one asks with, and the key's hub a, the set that shares its keys with the most."""
    shares = full.groupBy("id").agg(F.sum("n").alias("shares"))
    hubs = full.join(shares, "id").groupBy("key").agg(F.max(F.struct("shares", "id"))["id"].alias("hub"), F.max("asks").alias("open")).where("open").select("key", "hub")
    met = salted_lookup(full, hubs, "key", F.col("id"), 4).where(F.col("id") != F.col("hub"))
    return met.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()


def near_pairs(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """``a, b, part, apart``: the pairs(a, b) that sizes and sketches of facts(id, n_shingles, sketch) allow.

    ``part`` deals a hub's pairs over tasks.
    """
    spread = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts"))
    one = facts.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("sketch_a"))
    two = facts.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("sketch_b"))
    sides = one.join(spread, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = salted_lookup(pairs, spread, "a", F.col("b"), 4).select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("n_a", "sketch_a", "n_b", "sketch_b")]
            least = pa.array([apart(*x) for x in zip(*columns)], pa.int64())
            both = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "part")), least], names=["a", "b", "part", "apart"])
            yield both.filter(least.is_valid())

    # Sizes are compared before sketches meet.
    few = dealt.join(two, "b").join(sides, ["a", "part"]).where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    return few.select("a", "b", "part", "n_a", "sketch_a", "n_b", "sketch_b").mapInArrow(run, "a long, b long, part int, apart long")


def verified(close: DataFrame, texts: DataFrame) -> DataFrame:
    """The links among close(a, b, part); texts(id, text) has a row an id."""
    sides = close.select("a", "part").distinct().join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = close.select("a", "b", "part").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(sides, ["a", "part"])

    def run(batches):
        last, kept = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            found_a, found_b = [], []
            for k in range(0, len(a), 256):
                for i, own in enumerate((s for _, chunk in string_chunks(batch.column("text_b").slice(k, 256)) for s in shingle_sets(chunk)), k):
                    if a[i] != last:
                        kept = next(shingle_sets(chunk)[0] for _, chunk in string_chunks(batch.column("text_a").slice(i, 1)))
                        last = a[i]
                    if linked(kept, own):
                        found_a.append(a[i])
                        found_b.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _meetings(full: DataFrame, joined: DataFrame, facts: DataFrame) -> DataFrame:
    """Members of different components that share a key which one of them asks with, a row for each pair of blocks (g, low, high).

    Of a key of several components and three sets or more, the largest component's members meet the others, gathered by
    component over all keys; the others meet each other key by key, keys with the same others once.  Both are dealt over
    blocks, and each pair of blocks is compared as a whole in one task.
    """
    members = full.join(joined, "id", "left").select("key", "id", "asks", F.coalesce("component", "id").alias("c"))
    counts = members.groupBy("key", "c").agg(F.count("*").alias("n"), F.max("asks").alias("asks"))
    open_ = counts.groupBy("key").agg(F.max(F.struct("n", "c"))["c"].alias("main"), F.count("*").alias("parts"), F.sum("n").alias("all"), F.max("asks").alias("asks")).where("parts > 1 AND all > 2 AND asks").select("key", "main")
    dealt = cut(salted_lookup(members, open_, "key", F.col("id"), 4).where(F.col("main").isNotNull()))
    gathered = dealt.select(F.xxhash64(F.lit("main"), "main").alias("g"), "id", "c", "asks", (F.col("c") == F.col("main")).alias("is_main"), F.lit(True).alias("by_main"))
    others = dealt.where("c <> main")
    seen = others.groupBy("key").agg(F.bit_xor(F.xxhash64("id")).alias("same"), F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    once = seen.groupBy("same", "n").agg(F.min("key").alias("key")).select("key", F.lit(True).alias("once"))
    each = salted_lookup(others, once, "key", F.col("id"), 4).where("once").select(F.xxhash64(F.lit("key"), "key").alias("g"), "id", "c", F.lit(True).alias("asks"), F.lit(False).alias("is_main"), F.lit(False).alias("by_main"))
    dealt = cut(gathered.union(each).groupBy("g", "id", "c", "is_main", "by_main").agg(F.max("asks").alias("asks")))
    blocks = dealt.groupBy("g").agg(F.ceil(F.count(F.when(F.col("is_main"), 1)) / BLOCK).cast("int").alias("n_main"), F.ceil(F.count(F.when(~F.col("is_main"), 1)) / BLOCK).cast("int").alias("n_rest"))
    dealt = salted_lookup(dealt, blocks, "g", F.col("id"), 4)
    block = F.when(F.col("is_main"), F.pmod(F.xxhash64("id"), F.col("n_main"))).otherwise(F.pmod(F.xxhash64("id"), F.col("n_rest")) + F.col("n_main")).cast("int")
    rest = F.sequence(F.col("n_main"), F.col("n_main") + F.col("n_rest") - 1)
    meets = F.when(F.col("is_main") | ~F.col("by_main"), rest).otherwise(F.sequence(F.lit(0), F.col("n_main") - 1))
    rows = dealt.withColumn("block", block).join(facts, "id").withColumn("with", F.explode(meets))
    return rows.select("g", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "id", "c", "asks", (F.col("block") == F.least("block", "with")).alias("first"), "n_shingles", "sketch")


def _candidates(part: pa.Table):
    """Each member of the second block with those of the first that it may be linked with, likeliest first, and how far apart.

    Members of a block that stands alone meet each other.
    """
    first, c, asks, n = (np.array(part[x].to_pylist()) for x in ("first", "c", "asks", "n_shingles"))
    one, two = np.flatnonzero(first), np.flatnonzero(~first)
    raw = part["sketch"].to_pylist()
    widths = np.array([len(r) for r in raw])
    counts = {}
    for width in np.unique(widths).tolist():
        counts[width] = np.zeros((len(raw), width), np.int32)
        for i in np.flatnonzero(widths >= width):
            counts[width][i] = folded(raw[i], width)
    for i in two if len(two) else one:
        fits = one[(c[one] != c[i]) & (asks[one] | asks[i]) & (100 * np.minimum(n[one], n[i]) >= PERCENT * np.maximum(n[one], n[i]))]
        least = np.zeros(len(fits), np.int64)
        for width in np.unique(widths[fits]).tolist():
            at, both = widths[fits] == width, counts[min(width, int(widths[i]))]
            least[at] = np.abs(both[fits[at]] - both[i]).sum(axis=1)
        close = least <= (n[fits] + n[i]) * (100 - PERCENT) // (100 + PERCENT)
        fits, least = fits[close], least[close]
        order = np.argsort(least, kind="stable")
        yield int(i), fits[order], least[order]


def _across(full: DataFrame, joined: DataFrame, texts: DataFrame) -> DataFrame:
    """All links (a, b) that components still lack: sketches of whole blocks first, then texts of what is near there.

    Those near are dealt over small parts by size, so that texts come only for pairs of parts with candidates, and few
    texts are in one task.
    """
    rows = _meetings(full, joined, texts.select("id", "n_shingles", "sketch"))

    def close(part: pa.Table) -> pa.Table:
        met = [(i, hits) for i, hits, _ in _candidates(part) if len(hits)]
        first, n = np.array(part["first"].to_pylist(), bool), part["n_shingles"].to_numpy()
        alone = bool(first.all())
        sides = [np.unique(np.concatenate([np.zeros(0, np.int64), *x])) for x in ([hits for _, hits in met], [[i] for i, _ in met])]
        if alone:
            sides = [np.union1d(*sides)] * 2
        sides = [x[np.argsort(n[x], kind="stable")] for x in sides]
        place = [np.zeros(part.num_rows, np.int64) for _ in sides]
        for of, side in zip(place, sides):
            of[side] = np.arange(len(side)) // TEXTS
        pairs = sorted({(int(p), int(place[1][i])) for i, hits in met for p in np.unique(place[0][hits])})
        if alone:
            pairs = sorted({(min(x), max(x)) for x in pairs})
        at, flags, sub = [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, np.int32)]
        for k, (p, q) in enumerate(pairs):
            one, two = sides[0][p * TEXTS : (p + 1) * TEXTS], sides[1][q * TEXTS : (q + 1) * TEXTS]
            two = two[:0] if alone and p == q else two
            at += [one, two]
            flags.append(np.arange(len(one) + len(two)) < len(one))
            sub.append(np.full(len(one) + len(two), k, np.int32))
        out = part.take(pa.array(np.concatenate(at)))
        out = out.set_column(out.schema.get_field_index("first"), "first", pa.array(np.concatenate(flags)))
        return out.append_column("sub", pa.array(np.concatenate(sub)))

    def compare(part: pa.Table) -> pa.Table:
        ids, c, sets = part["id"].to_pylist(), part["c"].to_pylist(), []
        found: list[tuple[int, int]] = []
        for i, hits, _ in _candidates(part):
            met: set[int] = set()
            for j in hits.tolist():
                # One link to each component is enough for what follows.
                if c[j] in met:
                    continue
                sets = sets or [s for _, chunk in string_chunks(part["text"]) for s in shingle_sets(chunk)]
                if linked(sets[i], sets[j]):
                    met.add(c[j])
                    found.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    near = rows.groupBy("g", "low", "high").applyInArrow(close, StructType([*rows.schema.fields, StructField("sub", IntegerType())]))
    return near.join(texts.select("id", "text"), "id").groupBy("g", "low", "high", "sub").applyInArrow(compare, "a long, b long")


def join_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of docs(doc_id, text): the smallest doc_id reachable by links.

    Rows with equal sets are one class.  Texts without words stand alone; rows without a doc_id have no component and link
    with nothing.  Rows of one doc_id with different texts are sets of their own under one name.  An empty table gives an
    empty one, and other columns of docs take no part.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    named = docs.where(F.col("doc_id").isNotNull())
    rows = cut(sizes(docs))
    own = rows.where(F.col("doc_id").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("doc_id", "h", "n_shingles", "sketch")).alias("x"))
    own = cut(own.select("id", "x.*"))
    full = cut(shared_keys(named))
    close = cut(near_pairs(cut(hub_pairs(full)), own))
    several = full.groupBy("key").agg(F.count("*").alias("n"), F.max("asks").alias("asks")).where("n > 2 AND asks")
    wanted = close.select(F.col("a").alias("id")).union(close.select("b")).union(full.join(several, "key", "left_semi").select("id")).distinct()
    texts = cut(docs.join(own.join(wanted, "id", "left_semi"), ["doc_id", "h"]).dropDuplicates(["id"]).select("id", "text", "n_shingles", "sketch"))
    # The nearest hub of each set comes first; what that joins needs no other link.
    nearest = cut(close.groupBy("b").agg(F.min(F.struct("apart", "a", "part")).alias("x")).select("x.a", "b", "x.part"))
    links = cut(verified(nearest, texts))
    joined = components(links)
    of = joined.union(joined.select(F.col("component").alias("id"), "component").distinct())
    sides = close.join(nearest, ["a", "b"], "left_anti").join(of.select(F.col("id").alias("a"), F.col("component").alias("c_a")), "a", "left").join(of.select(F.col("id").alias("b"), F.col("component").alias("c_b")), "b", "left")
    rest = sides.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b", "part")
    more = cut(verified(rest, texts).union(_across(full, joined, texts)))
    if not more.isEmpty():
        joined = components(links.union(more))
    joined = joined.union(joined.select(F.col("component").alias("id"), "component").distinct())
    of = own.select("id", F.col("doc_id").alias("first")).join(joined, "id", "left").withColumn("c", F.coalesce("component", "id"))
    names = of.groupBy("c").agg(F.min("first").alias("component_id"))
    labels = of.join(names, "c").select("id", "component_id")
    out = salted_lookup(rows.select("doc_id", "n_shingles", "id"), labels, "id", F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
