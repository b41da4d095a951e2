"""Splits by binary, and flags for functions that leak from train."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _seeded(bins: DataFrame, seed: str) -> DataFrame:
    """Binaries numbered in the order of a seeded hash, with their number; a row a binary."""
    order = Window.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "bin"), 256), "bin")
    return bins.withColumn("rn", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))


def split_by_binary(bins: DataFrame, seed: str, share: float = 0.1) -> DataFrame:
    """``bin, split`` of distinct bins: int(share n) test, as many dev, the rest train; train is never empty."""
    part = F.floor(F.col("n") * share)
    kind = F.when(F.col("rn") <= part, "test").when(F.col("rn") <= 2 * part, "dev").otherwise("train")
    return _seeded(bins, seed).select("bin", kind.alias("split"))


def split_with_test_list(bins: DataFrame, test: DataFrame, seed: str, share: float = 0.1) -> DataFrame:
    """Listed binaries are test; a share of the others is dev."""
    rest = _seeded(bins.join(test.select("bin"), "bin", "left_anti"), seed)
    rest = rest.select("bin", F.when(F.col("rn") <= F.floor(F.col("n") * share), "dev").otherwise("train").alias("split"))
    return bins.join(test.select("bin"), "bin", "left_semi").select("bin", F.lit("test").alias("split")).unionByName(rest)


def last_definition_wins(functions: DataFrame, order: str) -> DataFrame:
    """One body for each (bin, func_name): the one defined last."""
    return functions.groupBy("bin", "func_name").agg(F.max_by("body", order).alias("body"))


def function_name_in_train(functions: DataFrame, train: DataFrame) -> DataFrame:
    names = train.select("func_name").distinct().withColumn("name_in_train", F.lit(True))
    return functions.join(names, "func_name", "left").withColumn("name_in_train", F.coalesce("name_in_train", F.lit(False)))


def function_body_in_train(functions: DataFrame, train: DataFrame) -> DataFrame:
    """Whether train has the same name with the same body; digests are shuffled, not bodies."""
    known = train.select("func_name", F.sha2("body", 256).alias("digest")).distinct().withColumn("body_in_train", F.lit(True))
    keyed = functions.withColumn("digest", F.sha2("body", 256))
    return keyed.join(known, ["func_name", "digest"], "left").withColumn("body_in_train", F.coalesce("body_in_train", F.lit(False))).drop("digest")


def annotate_split(functions: DataFrame) -> DataFrame:
    """Both flags on functions(bin, func, func_name, body, split); null on train rows."""
    train = last_definition_wins(functions.where("split = 'train'"), "func")
    flagged = function_body_in_train(function_name_in_train(functions.where("split <> 'train'"), train), train)
    rest = functions.where("split = 'train'").withColumns({"name_in_train": F.lit(None).cast("boolean"), "body_in_train": F.lit(None).cast("boolean")})
    return flagged.unionByName(rest)
