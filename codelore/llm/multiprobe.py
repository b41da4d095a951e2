"""Nearest neighbours by multiprobe p-stable hashing.

Largest inner products become nearest points: vectors are scaled into the unit ball and lifted onto its
sphere by one more coordinate, queries get nought there.  Each table hashes by floors of shifted Gaussian
projections; a query visits its own bucket and those that step over sides of some of its cells, in the order of the
sums of squared distances to those sides, the estimate of where neighbours fall.  Candidates of all tables are
compared by their inner products with the original vectors, in double precision, and merged.

Tables, cells, width and number of probes are fitted on a bounded sample: of the settings that find enough of the
sample's own neighbours, at every size of table the one with the least expected work a query, candidates and rows
sent counted together.  Every vector is indexed.  Equal vectors are hashed and compared once: only the k + 1 smallest
ids of them can be among the k nearest of any query, since ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mixed, salted_lookup

#: Vectors in the sample at most, those of them that the index is fitted on, how many of these ask, and the share of
#: neighbours that it is to find.
SAMPLE, FITTED, ASKING, RECALL = 16384, 4000, 100, 0.97
#: Settings that are tried, and the most probes a table.
TABLES, CELLS, WIDTHS, PROBES = 3, (2, 3, 4, 6, 8, 12, 16, 24, 32), (0.35, 0.6, 1.0, 1.6, 2.4, 3.6), 512
#: Comparisons that count as much as sending one vector.
SENT = 16
#: Vectors and queries of a bucket that one task compares.
BLOCK, ASKED = 4096, 2048
_ODD = np.random.default_rng(41).integers(1 << 62, 1 << 63, max(CELLS), dtype=np.uint64) | np.uint64(1)


def probe_sets(cells: int, most: int = PROBES) -> np.ndarray:
    """Sets of sides to step over, a row a set, in the order of their expected costs, the empty one first.

    A column is the rank of a side among a query's 2 * cells sides by their distance; the side opposite to
    the one of rank r has the last rank but r, and no set holds both.  The expected square of each rank's distance is that of
    ordered uniform numbers.
    """
    j = np.arange(1, 2 * cells + 1)
    k = 2 * cells + 1 - j
    low = (cells + 1) * (cells + 2) * 4
    cost = np.where(j <= cells, j * (j + 1) / low, 1 - k / (cells + 1) + k * (k + 1) / low)
    sets, heap = [()], [(float(cost[0]), (0,))]
    while heap and len(sets) < most:
        total, ranks = heapq.heappop(heap)
        last = ranks[-1]
        if 2 * cells - 1 - last not in ranks:
            sets.append(ranks)
        if last + 1 < 2 * cells:
            # A set with both sides of a cell has none but bad ones after it that grow from it.
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*ranks[:-1], last + 1)))
            if 2 * cells - 1 - last not in ranks:
                heapq.heappush(heap, (total + cost[last + 1], (*ranks, last + 1)))
    out = np.zeros((len(sets), 2 * cells), np.float32)
    for i, ranks in enumerate(sets):
        out[i, list(ranks)] = 1
    return out


@dataclass
class Index:
    planes: np.ndarray  # table, cell, dimension + 1
    shifts: np.ndarray  # table, cell, shares of the width
    sets: np.ndarray
    width: float
    probes: int
    scale: float
    sample: np.ndarray
    #: What the fit found: the share of the sample's neighbours found, and of all vectors compared, each table counted.
    recall: float = 0.0
    share: float = 1.0

    def bounds(self, q: np.ndarray, k: int) -> np.ndarray:
        """What a few more than k of the sample reach with each query: none of its k nearest of all lies under it.

        The few more leave room for neighbours that the probes miss.
        """
        k += k // 4 + 1
        if len(self.sample) < k:
            return np.full(len(q), -np.inf)
        return np.concatenate([np.partition(q[i : i + 256] @ self.sample.T, -k, axis=1)[:, -k] for i in range(0, len(q), 256)])

    def lifted(self, x: np.ndarray) -> np.ndarray:
        short = x / self.scale
        return np.concatenate([short, np.sqrt(np.maximum(0, 1 - (short**2).sum(axis=1)))[:, None]], axis=1)

    def asking(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([q / np.linalg.norm(q, axis=1)[:, None], np.zeros((len(q), 1))], axis=1)

    def _cells(self, lifted: np.ndarray, table: int) -> np.ndarray:
        return lifted @ self.planes[table].T / self.width + self.shifts[table]

    def keys(self, lifted: np.ndarray, table: int) -> np.ndarray:
        """Bucket of each vector."""
        return _joined(np.floor(self._cells(lifted, table)).astype(np.int64))

    def probed(self, lifted: np.ndarray, table: int) -> np.ndarray:
        """Buckets that each query visits, likeliest first."""
        out = []
        n = self.planes.shape[1]
        part = max(1, (32 << 20) // (self.probes * 8 * 4 * n))
        for at in range(0, len(lifted), part):
            cells = self._cells(lifted[at : at + part], table)
            base = np.floor(cells)
            inside = cells - base
            sides = np.concatenate([inside, 1 - inside], axis=1)
            order = np.argsort(sides, axis=1, kind="stable")
            total = np.take_along_axis(sides, order, axis=1) ** 2 @ self.sets.T
            chosen = self.sets[np.argsort(total, axis=1, kind="stable")[:, : self.probes]]
            way = np.zeros((len(cells), 2 * n, n), np.float32)
            way[np.arange(len(cells))[:, None], np.arange(2 * n)[None, :], order % n] = np.where(order < n, -1, 1)
            steps = np.matmul(chosen, way).astype(np.int64)
            out.append(_joined((base[:, None, :].astype(np.int64) + steps).reshape(-1, n)).reshape(len(cells), -1))
        return np.concatenate(out) if out else np.zeros((0, self.probes), np.int64)


def _joined(cells: np.ndarray) -> np.ndarray:
    return mixed((cells.astype(np.uint64) * _ODD[: cells.shape[1]]).sum(axis=1, dtype=np.uint64)).astype(np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v, doubles, a row a vec_id; without rows that take no part, and those of another length than most.

    Of several vectors of one vec_id the smallest counts, compared number by number.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count_distinct("vec_id").alias("count")).orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def fit(rows: DataFrame, k: int = 20, every: int = 20, seed: int = 23) -> tuple[Index, int]:
    """An index for the vectors of rows(vec_id, v), and their number."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    n, most = rows.agg(F.count("*"), F.max(norm)).first()
    sample = _matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v"))
    draw = np.random.default_rng(seed)
    d = sample.shape[1] + 1
    planes, shifts = draw.standard_normal((TABLES, max(CELLS), d)), draw.random((TABLES, max(CELLS)))
    index = Index(planes, shifts, probe_sets(2), max(WIDTHS), 9, (most or 1.0) * (1 + 1e-9), sample)
    index = replace(index, planes=planes[:1, :2], shifts=shifts[:1, :2])
    if n < 2:
        return index, n
    sample, queries = sample[:FITTED], sample[:ASKING]
    exact = queries @ sample.T
    exact[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    # Among fewer vectors as many neighbours lie farther off: the sample's share of them, three at least.
    near = min(len(sample) - 1, max(3, -(-k * len(sample) // n)))
    best = np.argsort(-exact, axis=1, kind="stable")[:, :near]
    points, asking, least, stale = index.lifted(sample), index.asking(queries), np.inf, 0
    for cells in CELLS:
        if stale == 2:  # more cells have not helped twice
            break
        stale += 1
        # More probes would cost more than comparing with all.
        sets = probe_sets(cells, int(min(PROBES, max(9, n // SENT))))
        for width in WIDTHS:
            tried = Index(planes[:, :cells], shifts[:, :cells], sets, width, len(sets), index.scale, index.sample)
            places = np.stack([_places(tried.keys(points, t), tried.probed(asking, t)) for t in range(TABLES)])
            for tables in range(1, TABLES + 1):
                found = np.sort(np.take_along_axis(places[:tables].min(axis=0), best, axis=1).ravel())
                need = int(found[int(np.ceil(RECALL * len(found))) - 1])
                if need >= len(sets):
                    continue
                share = float((places[:tables] <= need).sum(axis=0).mean())
                work = n * share + SENT * tables * (need + 1 + every)
                if work < least:
                    least, stale = work, 0
                    index = replace(tried, planes=planes[:tables, :cells], shifts=shifts[:tables, :cells], probes=need + 1, recall=float((found <= need).mean()), share=share)
    return index, n


def _places(keys: np.ndarray, probed: np.ndarray) -> np.ndarray:
    """At which probe each query meets each vector; past the last one if at none."""
    known, of = np.unique(keys, return_inverse=True)
    at = np.minimum(np.searchsorted(known, probed), len(known) - 1)
    meets = known[at] == probed
    when = np.full((len(probed), len(known)), probed.shape[1], np.int32)
    one, two = np.nonzero(meets)
    when[one[::-1], at[one, two][::-1]] = two[::-1]
    return when[:, of]


def search(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest of each query, the rows whose vec_id divides by ``every``.

    Repeated rows of a vec_id are one candidate and one query, with the vector that ``usable`` takes.  A query's own
    vec_id is no candidate.  Ties go to the smaller vec_id.  Null vectors, zero ones, and those with null or non-finite
    numbers take no part.  An empty table, or one with a single vector, gives no rows.
    """
    # Two 64-bit hashes name a vector from here on.
    rows = cut(usable(vectors).withColumn("same", F.struct(F.xxhash64("v").alias("one"), F.xxhash64(F.lit(1), "v").alias("two"))))
    order = Window.partitionBy("same").orderBy("vec_id")
    points = cut(rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("vec_id", "v", "r"))
    index, n = fit(points.where("r = 1").select("vec_id", "v"), k, every)
    data = points.select("vec_id", "v")
    # Equal queries ask once, by their smallest id, for one more than k, as each of them is to be left out of its own.
    asking = rows.where(F.col("vec_id") % every == 0)
    queries = cut(asking.groupBy("same").agg(F.min("vec_id").alias("vec_id"), F.min("v").alias("v")))
    found = cut(_nearest(data, queries.select("vec_id", "v"), index, k + 1))
    # A query in so thin a region that its buckets hold fewer than there are is compared with all.
    enough = found.groupBy(F.col("query_id").alias("vec_id")).count().where(F.col("count") >= min(k + 1, data.count()))
    short = queries.join(enough, "vec_id", "left_anti").select("vec_id", "v")
    if not short.isEmpty():
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(_nearest(data, short, None, k + 1))
    lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near"))
    lists = queries.join(lists, F.col("vec_id") == F.col("query_id")).select("same", "near")
    each = salted_lookup(asking.select("vec_id", "same"), lists, "same", F.col("vec_id")).where(F.col("near").isNotNull())
    each = each.select(F.col("vec_id").alias("query_id"), F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k).alias("near"))
    each = each.select("query_id", F.posexplode("near").alias("at", "x"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def _nearest(rows: DataFrame, queries: DataFrame, index: Index | None, k: int) -> DataFrame:
    """``query_id, vec_id, score`` of the k best of each query among those that share a probed bucket; of all, without an index.

    A bucket's vectors and its queries are dealt over blocks, each pair of which is compared in one task.
    """
    shared = rows.sparkSession.sparkContext.broadcast(index)
    tables = index.planes.shape[0] if index else 1

    def keyed(batches):
        own = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = own.lifted(_matrix(batch.column("v"))) if own else None
            for t in range(tables):
                keys = own.keys(x, t) if own else np.zeros(batch.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(np.full(len(keys), t, np.int32)), pa.array(keys)], names=["vec_id", "v", "t", "key"])

    def probing(batches):
        own = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column("v"))
            bound = own.bounds(q, k) if own else np.full(len(q), -np.inf)
            for t in range(tables):
                keys = own.probed(own.asking(q), t) if own else np.zeros((len(q), 1), np.int64)
                ends = np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(np.full(len(q), t, np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel())), pa.array(bound)], names=["vec_id", "v", "t", "keys", "bound"])

    data = rows.mapInArrow(keyed, "vec_id long, v array<double>, t int, key long")
    asked = queries.mapInArrow(probing, "vec_id long, v array<double>, t int, keys array<long>, bound double").select("vec_id", "v", "t", "bound", F.explode("keys").alias("key"))
    held = data.groupBy("t", "key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    met = asked.groupBy("t", "key").agg(F.ceil(F.count("*") / ASKED).alias("groups"))
    buckets = cut(held.join(met, ["t", "key"]))

    def dealt(some: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id"), F.col(own)).alias(own)
        return some.join(buckets, ["t", "key"]).select("t", "key", mine, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other), *(c for c in some.columns if c not in ("t", "key")))

    def best(some: pa.Table, of: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], []]
        if some.num_rows and of.num_rows:
            x, q = _matrix(some.column("v")), _matrix(of.column("v"))
            ids, asking, bound = some.column("vec_id").to_numpy(), of.column("vec_id").to_numpy(), of.column("bound").to_numpy()
            part = max(1, (8 << 20) // (8 * len(x)))
            for at in range(0, len(q), part):
                near = q[at : at + part] @ x.T
                least = np.partition(near, -k, axis=1)[:, -k] if len(x) > k else np.full(len(near), -np.inf)
                least = np.maximum(least, bound[at : at + part])
                # Ties, and what rounding may have put just below, are told apart by the exact sums.
                one, two = np.nonzero(near >= (least - 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0))))[:, None])
                score = np.zeros(len(one))
                for d in range(x.shape[1]):
                    score += q[at + one, d] * x[two, d]
                order = np.lexsort((ids[two], -score, one))
                one, two, score = one[order], two[order], score[order]
                first = np.searchsorted(one, np.arange(len(near)))
                keep = np.arange(len(one)) - first[one] < k
                found[0].append(asking[at + one[keep]])
                found[1].append(ids[two[keep]])
                found[2].append(score[keep])
        a, b, c = (np.concatenate(f) if f else [] for f in found)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    key = ("t", "key", "blocks", "groups")
    close = dealt(data, "blocks", "groups").groupBy(*key).cogroup(dealt(asked, "groups", "blocks").groupBy(*key)).applyInArrow(best, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # Every table may name a neighbour once: so many rows hold the k nearest of a query.
    top = close.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k * tables).drop("rank")
    merged = top.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
