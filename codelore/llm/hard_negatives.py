"""Hard negatives by coordinate pruning over length buckets.

Rows are dealt by their length into buckets, and a bucket's rows over blocks; each block keeps, for every coordinate, its
rows sorted by that coordinate of their directions.  An anchor that wants inner products of at least t asks a block whose
longest row is l for directions with a cosine of at least c = t / (|anchor| l).  A block with c > 1 is left out.  In the
others a row can only qualify if each of its coordinates f lies within q_f c -+ sqrt((1 - c^2)(1 - q_f^2)), q being the
anchor's direction: the ranges of the anchor's largest coordinates are looked up in the sorted lists, and rows found in
all of them are compared exactly, in integers.

What an anchor may want is bounded from below by a bounded sample of the rows, which are candidates themselves: the score
of its fifth best row of the same label there, and for each positive the tenth best that lies in its window.  With too few
of those the window's own lower end counts.  The sample only prunes; it never decides what is returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows in the sample at most, and bytes of it at most.
SAMPLE, SAMPLE_BYTES = 2048, 4 << 20
#: Rows and anchors of a block, coordinates that are looked up, and the ratio of lengths in a bucket.
BLOCK, ASKED, FOCUS, RATIO = 4096, 512, 4, 0.9
#: A component counts as at most so much; up to 512 such products add up to a long.
LARGEST = 1 << 27


def usable(vectors: DataFrame, scale: int = 256, every: int = 7, labels: int = 10) -> DataFrame:
    """``vec_id, label, v`` (components floor(scale * x) as longs), a row a vec_id.

    Rows with a null vec_id, label or vector, with null or non-finite components, or of another length than most vectors
    take no part; zero vectors do.  Of several rows of one vec_id the smallest vector counts, with its smallest label.
    Components beyond 2**27 count as 2**27.  Where vec_id divides by ``every``, the label becomes the next one modulo ``labels``.
    """
    x = F.col("embedding").cast("array<double>")
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    rows = rows.where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    whole = F.transform("x", lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c * scale, F.lit(1e18)), F.lit(-1e18))), F.lit(LARGEST)), F.lit(-LARGEST)).cast("long"))
    rows = rows.select("vec_id", "label", whole.alias("v"))
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count_distinct("vec_id").alias("count")).orderBy(F.desc("count"), "n").first()
    one = rows.where(F.size("v") == (common["n"] if common else 0)).groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("r"))
    changed = F.when(F.col("vec_id") % every == 0, (F.col("r.label") + 1) % labels).otherwise(F.col("r.label"))
    return one.select("vec_id", changed.alias("label"), F.col("r.v").alias("v"))


def _length(v: str = "v") -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles, which are quicker, where these are exact."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


class Block:
    """Rows of one length bucket with a sorted list a coordinate."""

    def __init__(self, x: np.ndarray):
        self.x = x
        lengths = np.linalg.norm(x.astype(np.float64), axis=1)
        self.longest = float(lengths.max()) if len(lengths) else 0.0
        unit = x / np.maximum(lengths, 1e-300)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable")
        self.lists = np.take_along_axis(unit, self.order, axis=0)
        #: A bucket's zero rows fit any direction: their score is nought.
        self.zero = np.flatnonzero(lengths == 0)

    def candidates(self, q: np.ndarray, least: float) -> np.ndarray | None:
        """Rows that may reach ``least`` with the anchor; None for all of them."""
        length = float(np.linalg.norm(q.astype(np.float64)))
        if least <= 0 or not length:
            return None if least <= 0 else np.zeros(0, np.int64)
        if least > length * self.longest * (1 + 1e-9):
            return np.zeros(0, np.int64)
        # Rows shorter than the longest need a larger cosine, so that this one misses none.
        c = min(1.0, least / (length * self.longest))
        unit = q / length
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        found = np.zeros(len(self.x), np.int8)
        for f in focus:
            spread = math.sqrt(max(0.0, (1 - c * c) * (1 - unit[f] ** 2))) + 1e-9
            # At the ends of the sphere a cosine of one is reached within the range, and all beyond it count.
            low = -2.0 if -unit[f] >= c else unit[f] * c - spread
            high = 2.0 if unit[f] >= c else unit[f] * c + spread
            i, j = np.searchsorted(self.lists[:, f], (low, high))
            found[self.order[i:j, f]] += 1
        return np.flatnonzero(found == len(focus))


def _first(values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values, ties by smaller ids, in order."""
    if len(values) > 4 * k:
        at = np.flatnonzero(values >= np.partition(values, -k)[-k])
        return at[np.lexsort((ids[at], -values[at]))][:k]
    return np.lexsort((ids, -values))[:k]


def _sampled(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors of rows drawn by hash, so many that they keep within SAMPLE and SAMPLE_BYTES."""
    one = rows.select(F.size("v")).first()
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, one[0] if one else 1))))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("vec_id", "label", "v").toArrow()
    return drawn["vec_id"].to_numpy(), drawn["label"].to_numpy(), _matrix(drawn["v"])


def _compared(rows: DataFrame, asking: DataFrame, found, schema: str) -> DataFrame:
    """Each block of rows beside the anchors that may find anything in its bucket.

    ``asking`` has vec_id, label, v, length, least and whatever else ``found`` reads; ``found(block, ids, labels, anchors)`` gives a
    table of the schema.  Rows are dealt by bucket of length and hash, anchors by hash.
    """
    bucket = F.when(F.col("length") > 0, F.floor(F.log(F.col("length")) / -math.log(RATIO)).cast("int")).otherwise(F.lit(-(1 << 20)))
    keyed = rows.withColumn("bucket", bucket)
    sizes = keyed.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.max("length").alias("longest"))
    sizes = cut(sizes)
    groups = max(1, -(-asking.count() // ASKED))
    parts = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part")
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block")
    data = keyed.join(sizes, "bucket").select(F.col("bucket").alias("bucket"), block, "vec_id", "label", "v", parts)
    grid = sizes.select(F.col("bucket").alias("bucket"), "longest", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select("*", parts)
    asked = asking.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).join(grid, "part")
    asked = asked.where(F.col("least") <= F.col("length") * F.col("longest") * (1 + 1e-9)).drop("longest")

    def run(some: pa.Table, of: pa.Table) -> pa.Table:
        if not some.num_rows or not of.num_rows:
            return found(None, None, None, of.slice(0, 0))
        return found(Block(_matrix(some["v"])), some["vec_id"].to_numpy(), some["label"].to_numpy(), of)

    key = ("bucket", "block", "part")
    return data.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(run, schema)


def _qualified(block: Block, of: pa.Table):
    """For every anchor its number, the places of its candidates in the block, and their exact scores."""
    q, least, whole = _matrix(of["v"]), of["least"].to_numpy(), None
    for i in range(len(q)):
        at = block.candidates(q[i], least[i])
        if at is None or 2 * len(at) > len(block.x):  # most are candidates: all anchors that find so many are multiplied together
            if whole is None:
                whole = scores(q, block.x)
            yield i, (np.arange(len(block.x)), whole[i]) if at is None else (at, whole[i][at])
        elif len(at):
            yield i, (at, scores(q[i : i + 1], block.x[at])[0])


def _table(found: list[tuple], schema: str) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    columns = zip(*found) if found else [[] for _ in names]
    return pa.table({name: pa.array(list(c), pa.int64()) for name, c in zip(names, columns)})


POSITIVE = "anchor_id long, positive_id long, positive_score long"
NEGATIVE = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def best_positives(rows: DataFrame, anchors: DataFrame, sample, count: int) -> DataFrame:
    """``anchor_id, positive_id, positive_score`` of each anchor's best other rows of its label; ties to smaller ids."""
    shared = rows.sparkSession.sparkContext.broadcast(sample)

    def bound(batches):
        ids, labels, x = shared.value
        for batch in batches:
            own, label, q = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch.column("v"))
            least = np.full(len(own), -np.inf)
            for i, score in enumerate(scores(q, x)):
                alike = score[(labels == label[i]) & (ids != own[i])]
                if len(alike) >= count:
                    least[i] = np.partition(alike, -count)[-count]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least)], names=[*batch.schema.names, "least"])

    def found(block, ids, labels, of):
        out = []
        if of.num_rows:
            own, label = of["vec_id"].to_pylist(), of["label"].to_pylist()
            for i, (at, score) in _qualified(block, of):
                alike = (labels[at] == label[i]) & (ids[at] != own[i])
                at, score = at[alike], score[alike]
                out += [(own[i], int(ids[at[j]]), int(score[j])) for j in _first(score, ids[at], count)]
        return _table(out, POSITIVE)

    asking = cut(anchors.select("vec_id", "label", "v", "length").mapInArrow(bound, "vec_id long, label long, v array<long>, length double, least double"))
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = _compared(rows, asking, found, POSITIVE)
    return near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= count).drop("r")


def best_negatives(rows: DataFrame, asking: DataFrame, sample, k: int) -> DataFrame:
    """The best rows of another label in the window of each positive.

    ``asking`` has vec_id, label, v, length and ``wanted``, an array of (positive_id, positive_score, low, high) an anchor.
    """
    shared = rows.sparkSession.sparkContext.broadcast(sample)
    wanted = "array<struct<positive_id: long, positive_score: long, low: long, high: long>>"

    def bound(batches):
        ids, labels, x = shared.value
        for batch in batches:
            label, q, lists = batch.column("label").to_numpy(), _matrix(batch.column("v")), batch.column("wanted").to_pylist()
            least = []
            for i, score in enumerate(scores(q, x)):
                other = score[labels != label[i]]
                for w in lists[i]:
                    fits = other[(other >= w["low"]) & (other <= w["high"])]
                    if len(fits) >= k:
                        w["low"] = int(np.partition(fits, -k)[-k])
                least.append(float(min(w["low"] for w in lists[i])))
            kept = [batch.column(c) for c in ("vec_id", "label", "v", "length")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lists, batch.schema.field("wanted").type), pa.array(least, pa.float64())], names=["vec_id", "label", "v", "length", "wanted", "least"])

    def found(block, ids, labels, of):
        out = []
        if of.num_rows:
            own, label, lists = of["vec_id"].to_pylist(), of["label"].to_pylist(), of["wanted"].to_pylist()
            for i, (at, score) in _qualified(block, of):
                for w in lists[i]:
                    fits = np.flatnonzero((score >= w["low"]) & (score <= w["high"]) & (labels[at] != label[i]))
                    chosen = fits[_first(score[fits], ids[at[fits]], k)]
                    out += [(own[i], w["positive_id"], w["positive_score"], int(ids[at[j]]), int(score[j])) for j in chosen]
        return _table(out, NEGATIVE)

    asking = cut(asking.select("vec_id", "label", "v", "length", "wanted").mapInArrow(bound, f"vec_id long, label long, v array<long>, length double, wanted {wanted}, least double"))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    near = _compared(rows, asking, found, NEGATIVE)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from vectors(vec_id, embedding, label).

    Anchors are the rows whose vec_id divides by ``every``; all rows are candidates, as ``usable`` has them.  The negatives of a
    positive are the k best rows of another label with low * positive <= 100 * negative <= high * positive, ties to smaller ids; an
    anchor without positives, or a positive without rows in its window (every negative one), has no rows.  An empty table
    gives an empty one; other columns of vectors take no part.
    """
    rows = cut(usable(vectors).withColumn("length", _length()))
    anchors = rows.where(F.col("vec_id") % every == 0)
    sample = _sampled(rows)
    liked = best_positives(rows, anchors, sample, positives)
    # Whole numbers within 100 times a score lie within a long; the ends of a window are rounded inwards.
    score = F.col("positive_score").cast("decimal(38,0)")
    window = liked.withColumns({"low": F.ceil(score * low / 100).cast("long"), "high": F.floor(score * high / 100).cast("long")}).where("low <= high")
    wanted = window.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score", "low", "high"))).alias("wanted"))
    found = best_negatives(rows, anchors.join(wanted, "vec_id"), sample, k)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
