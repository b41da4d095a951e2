"""Statistics of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelore.operators.features import numbered


def length_stats(lengths: DataFrame, column: str) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), F.round(F.avg(column), 6).alias("mean"), F.round(F.median(column), 6).alias("median"))


def unique_functions(functions: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct pairs of name and tokens, by digest."""
    digest = F.sha2(F.concat_ws("\x01", "name", F.array_join("tokens", " ")), 256)
    return functions.agg((F.approx_count_distinct(digest) if approximate else F.count_distinct(digest)).alias("unique_functions"))


def unique_binaries(functions: DataFrame) -> DataFrame:
    return functions.agg(F.count_distinct("bin").alias("unique_binaries"))


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 8, brought back by the product in between."""
    x = (n + 8).cast("double")
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    product = n.cast("double") + 1
    for k in range(2, 8):
        product = product * (n + k)
    return series - F.log(product)


def mutual_information(rows: DataFrame, x: str, y: str, adjusted: bool = True) -> DataFrame:
    """MI in nats, normalised by the mean entropy, and adjusted for chance unless ``adjusted`` is false.

    The expectation sums over pairs of distinct marginals, each taken as often as it occurs; of the counts that a pair can
    have only those within 12 deviations of their mean, beyond which the terms vanish in double precision.  Its cost grows with
    the product of the numbers of distinct marginals; without it, one join a side is all.
    """
    table = rows.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    a = table.groupBy("x").agg(F.sum("n").alias("a"))
    b = table.groupBy("y").agg(F.sum("n").alias("b"))
    total = table.agg(F.sum("n").alias("total"))
    entropy = lambda side, c: side.crossJoin(F.broadcast(total)).agg((-F.sum(F.col(c) / F.col("total") * F.log(F.col(c) / F.col("total")))).alias(f"h_{c}"))
    joint = table.join(a, "x").join(b, "y").crossJoin(F.broadcast(total))
    mi = joint.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("a") * F.col("b")))).alias("mi"))
    if not adjusted:
        one = mi.crossJoin(F.broadcast(entropy(a, "a"))).crossJoin(F.broadcast(entropy(b, "b")))
        return one.select(F.round("mi", 6).alias("mi"), F.round(2 * F.col("mi") / (F.col("h_a") + F.col("h_b")), 6).alias("nmi"))
    sides = a.groupBy("a").agg(F.count("*").alias("na")).join(b.groupBy("b").agg(F.count("*").alias("nb"))).crossJoin(F.broadcast(total))
    mean = F.col("a") * F.col("b") / F.col("total")
    spread = F.sqrt(mean * (1 - F.col("a") / F.col("total")) * (1 - F.col("b") / F.col("total"))) * 12 + 12
    low = F.greatest(F.lit(1), F.col("a") + F.col("b") - F.col("total"), F.floor(mean - spread))
    high = F.least(F.col("a"), F.col("b"), F.ceil(mean + spread))
    cells = sides.where(low <= high).withColumn("k", F.explode(F.sequence(low, high)))
    k, n = F.col("k"), F.col("total")
    ln = _log_factorial
    weight = ln(F.col("a")) + ln(F.col("b")) + ln(n - F.col("a")) + ln(n - F.col("b")) - ln(n) - ln(k) - ln(F.col("a") - k) - ln(F.col("b") - k) - ln(n - F.col("a") - F.col("b") + k)
    term = k / n * F.log(n * k / (F.col("a") * F.col("b"))) * F.exp(weight) * F.col("na") * F.col("nb")
    emi = cells.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("emi"))
    one = mi.crossJoin(F.broadcast(entropy(a, "a"))).crossJoin(F.broadcast(entropy(b, "b"))).crossJoin(F.broadcast(emi))
    middle = (F.col("h_a") + F.col("h_b")) / 2
    return one.select(F.round("mi", 6).alias("mi"), F.round(F.col("mi") / middle, 6).alias("nmi"), F.round((F.col("mi") - F.col("emi")) / (middle - F.col("emi")), 6).alias("ami"))


def shuffled(rows: DataFrame, key: str, y: str, seed: str) -> DataFrame:
    """``y`` dealt anew over all rows: the n-th row by key gets that of the n-th row by a seeded hash of the key.

    Both numberings go by ranges, so that no task orders everything; keys are to be unique.
    """
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    own = numbered(rows, key, into="_n")
    other = numbered(rows.select(draw.alias("_d"), F.col(key).alias("_k"), F.col(y).alias("_y")), "_d", "_k", into="_n").select("_n", "_y")
    return own.join(other, "_n").drop(y, "_n").withColumnRenamed("_y", y)


def legacy_stats(variables: DataFrame, trees: DataFrame) -> DataFrame:
    """Mean variables and renamed variables a function by split, with the mean size of the functions' trees."""
    each = variables.groupBy("split", "func").agg(F.count("*").alias("v"), F.sum((F.col("old_name") != F.col("new_name")).cast("int")).alias("r")).join(trees, "func")
    return each.groupBy("split").agg(F.round(F.avg("size"), 6).alias("tree_size"), F.round(F.avg("v"), 6).alias("variables"), F.round(F.avg("r"), 6).alias("renamed"))


def split_counts(functions: DataFrame, shard_size: int) -> DataFrame:
    """Binaries, functions and shards of each split."""
    counts = functions.groupBy("split").agg(F.count_distinct("bin").alias("bins"), F.count("*").alias("functions"))
    return counts.withColumn("shards", F.ceil(F.col("bins") / shard_size))


def leakage_rate(flagged: DataFrame) -> DataFrame:
    return flagged.where("split <> 'train'").groupBy("split").agg(F.round(F.avg(F.col("body_in_train").cast("int")), 6).alias("leakage"))


def vocab_report(words: DataFrame, cutoff: int, top: int = 30) -> DataFrame:
    """The commonest words with their ranks, beside the number of words and of those at the cutoff or over."""
    totals = words.agg(F.count("*").alias("words"), F.sum((F.col("freq") >= cutoff).cast("long")).alias("over_cutoff"))
    best = words.orderBy(F.desc("freq"), "word").limit(top).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("freq"), "word")).cast("long"))
    return best.crossJoin(F.broadcast(totals))


def dataset_size(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("examples"))
