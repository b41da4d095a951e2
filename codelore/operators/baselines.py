"""Predictions by counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def copy_source(test: DataFrame) -> DataFrame:
    return test.withColumns({"pred_type": F.col("src_type"), "pred_name": F.lit("")})


def most_common_for_size(typelib: DataFrame, test: DataFrame, largest: int = 1024) -> DataFrame:
    """The commonest type of the variable's size; none, and sizes over ``largest``, give the empty type."""
    first = F.row_number().over(Window.partitionBy("size").orderBy(F.desc("freq"), "type_str"))
    best = typelib.withColumn("rn", first).where((F.col("rn") == 1) & (F.col("size") <= largest)).select("size", F.col("type_str").alias("pred_type"))
    return test.join(best, "size", "left").withColumn("pred_type", F.coalesce("pred_type", F.lit("")))


def most_common_for_source(train: DataFrame, test: DataFrame) -> DataFrame:
    """The commonest target type of the source type in train; an unseen source type predicts itself."""
    return commonest_of_counts(train.groupBy("src_type", "tgt_type").agg(F.count("*").alias("n")), test)


def commonest_of_counts(counts: DataFrame, test: DataFrame) -> DataFrame:
    """The same from ``src_type, tgt_type, n`` of train."""
    first = F.row_number().over(Window.partitionBy("src_type").orderBy(F.desc("n"), "tgt_type"))
    best = counts.withColumn("rn", first).where("rn = 1").select("src_type", F.col("tgt_type").alias("pred_type"))
    return test.join(best, "src_type", "left").withColumn("pred_type", F.coalesce("pred_type", "src_type"))
