"""Feature tables and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelore.operators.lineage import cut


def numbered(rows: DataFrame, *order: Column | str, into: str = "n") -> DataFrame:
    """A global number from 0 in an order, without one task that sees all rows.

    Rows are dealt by ranges; each range numbers its own, after the sum of the ranges before it, a row a range.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = dealt.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return dealt.withColumn("_own", own).join(before, "_p").withColumn(into, (F.col("_own") + F.col("_before")).cast("long")).drop("_p", "_own", "_before")


def order_variables(rows: DataFrame, most: int = 32) -> DataFrame:
    """The first variables of (key, pieces, names) by the first place of their mark; unmentioned ones last, by name."""
    each = rows.select("key", "pieces", F.explode("names").alias("name"))
    place = F.array_position("pieces", F.concat(F.lit("@@"), "name", F.lit("@@")))
    placed = each.select("key", "name", F.when(place == 0, F.size("pieces") + 1).otherwise(place).cast("long").alias("place"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("place", "name"))
    return placed.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def variable_features(variables: DataFrame, columns: list[str]) -> DataFrame:
    """One row a function: its variables' columns as arrays in the order of pos."""
    rows = F.array_sort(F.collect_list(F.struct("pos", *columns)))
    return variables.groupBy("func").agg(rows.alias("_rows")).select("func", *(F.col("_rows").getField(c).alias(c) for c in columns))


def mention_positions(pieces: DataFrame, variables: DataFrame) -> DataFrame:
    """``key, pos, var`` of each piece of pieces(key, pieces) that marks a variable of variables(key, name, var);
    the highest number among equal names."""
    each = pieces.select("key", F.posexplode("pieces").alias("pos", "piece")).where(F.col("piece").startswith("@@"))
    names = variables.groupBy("key", F.concat(F.lit("@@"), "name", F.lit("@@")).alias("piece")).agg(F.max("var").alias("var"))
    return each.join(names, ["key", "piece"]).select("key", F.col("pos").cast("long").alias("pos"), "var")


def mention_counts(variables: DataFrame, mentions: DataFrame) -> DataFrame:
    """Mentions of each variable, whether it has any, and the older count that gives one to a missing variable."""
    counts = mentions.groupBy("key", "var").agg(F.count("*").alias("n"))
    out = variables.join(counts, ["key", "var"], "left").withColumn("mentions", F.coalesce("n", F.lit(0)))
    return out.select("key", "var", "mentions", (F.col("mentions") > 0).alias("seen"), F.greatest("mentions", F.lit(1)).cast("long").alias("legacy"))


def pad_batch(rows: DataFrame) -> DataFrame:
    """Arrays of rows(batch, key, ids), padded with 0 on the right to their batch's longest; ``mask`` is ids > 0."""
    longest = F.max(F.size("ids")).over(Window.partitionBy("batch"))
    padded = F.concat("ids", F.array_repeat(F.lit(0).cast("long"), (longest - F.size("ids")).cast("int")))
    return rows.withColumn("ids", padded).withColumn("mask", F.transform("ids", lambda x: x > 0))


def prediction_targets(variables: DataFrame, unchanged: float = 1.0) -> DataFrame:
    """Target pieces of each variable in a row each, whether its name changes, and the weight of those that don't."""
    changed = F.col("old_name") != F.col("new_name")
    pieces = F.when(~changed, F.array(F.lit("<IDENTITY>"), F.lit("</s>"))).otherwise(F.concat(F.split("new_name", "_"), F.array(F.lit("</s>"))))
    return variables.select("func", "pos", changed.alias("changed"), F.when(changed, F.lit(1.0)).otherwise(F.lit(unchanged)).alias("weight"), F.posexplode(pieces).alias("piece_pos", "piece"))


def interleave_targets(targets: DataFrame, types: int) -> DataFrame:
    """Of targets(func, pos, type_id, name_id), the type's id and then the name's, moved past the types, at 2 pos and 2 pos + 1."""
    return targets.select("func", (F.col("pos") * 2).alias("_at"), F.posexplode(F.array("type_id", F.col("name_id") + types)).alias("_k", "id")).select("func", (F.col("_at") + F.col("_k")).alias("at"), "id")


def length_buckets(rows: DataFrame, order: str, length: str, buffer: int) -> DataFrame:
    """Rows in consecutive buffers, ordered by length inside each."""
    bucketed = numbered(rows, order).withColumn("bucket", F.floor(F.col("n") / buffer))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(length, order)) - 1
    return bucketed.withColumn("place", rank.cast("long"))


def token_budget_batches(rows: DataFrame, limit: int, length: str = "length") -> DataFrame:
    """``batch`` of rows(bucket, place, length): rows in order join a batch while rows times longest stay in the limit.

    A longer row alone is its own batch.  Buckets are bounded, and each is packed by one task.
    """

    def pack(frame):
        frame = frame.sort_values("place")
        batch, count, longest, out = 0, 0, 0, []
        for n in frame[length]:
            if count and (count + 1) * max(longest, n) > limit:
                batch, count, longest = batch + 1, 0, 0
            count, longest = count + 1, max(longest, n)
            out.append(batch)
        return frame.assign(batch=out)[["bucket", "place", length, "batch"]]

    return rows.select("bucket", "place", length).groupBy("bucket").applyInPandas(pack, f"bucket long, place long, {length} long, batch long")


def fixed_batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    return numbered(rows, order).withColumn("batch", F.floor(F.col("n") / size))


def shuffle(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """A reproducible global order, the number of each row in it."""
    return numbered(rows.withColumn("_draw", F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)), "_draw", key).drop("_draw")


def _mean_by_dimension(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key, "dim").agg(F.avg("x").alias("x"))


def pool_mentions(vectors: DataFrame, key: str) -> DataFrame:
    """Mean vector of each key, a row a dimension."""
    return _mean_by_dimension(vectors.select(key, F.posexplode("vector").alias("dim", "x")).withColumn("x", F.col("x").cast("double")), key)


def masked_mean(lists: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean of the looked-up vectors of lists(key, ids), padding 0 left out; a row a dimension."""
    each = lists.select("key", F.explode("ids").alias("id")).where("id <> 0").join(vectors, "id")
    return pool_mentions(each, "key")


def neighbour_mean(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """Sum of the source vectors of each node over its number of edges and a little more; a row a dimension."""
    degree = edges.groupBy("dst").agg(F.count("*").alias("degree"))
    sums = edges.join(vectors.withColumnRenamed("id", "src"), "src").select("dst", F.posexplode("vector").alias("dim", "x")).groupBy("dst", "dim").agg(F.sum(F.col("x").cast("double")).alias("s"))
    return sums.join(degree, "dst").select("dst", "dim", (F.col("s") / (F.col("degree") + 1e-7)).alias("x"))


def padded_cost(batches: DataFrame, length: str) -> DataFrame:
    """Elements that the padded batches take: rows times longest, summed."""
    each = batches.groupBy("batch").agg((F.count("*") * F.max(length)).alias("cost"))
    return each.agg(F.sum("cost").alias("cost"), F.count("*").alias("batches"))
