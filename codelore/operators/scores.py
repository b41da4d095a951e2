"""Score tables of (item, class, score), and hypotheses of names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def add_layout_scores(model: DataFrame, layout: DataFrame) -> DataFrame:
    return model.join(layout.withColumnRenamed("score", "layout"), ["item", "class"]).select("item", "class", (F.col("score") + F.col("layout")).alias("score"))


def top_k(scores: DataFrame, k: int = 1) -> DataFrame:
    """The k best classes of each item, the smaller class first among equals."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "class"))
    return scores.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def log_softmax(scores: DataFrame) -> DataFrame:
    item = Window.partitionBy("item")
    top = F.max("score").over(item)
    shifted = scores.withColumn("_s", F.col("score") - top)
    return shifted.withColumn("log_prob", F.col("_s") - F.log(F.sum(F.exp("_s")).over(item))).drop("_s")


def ensemble_logsumexp(scores: DataFrame) -> DataFrame:
    """Log-sum-exp over the models of scores(model, item, class, score)."""
    top = scores.withColumn("_top", F.max("score").over(Window.partitionBy("item", "class")))
    return top.groupBy("item", "class").agg((F.max("_top") + F.log(F.sum(F.exp(F.col("score") - F.col("_top"))))).alias("score"))


def suppress_unknown(scores: DataFrame, unknown: int) -> DataFrame:
    return scores.withColumn("score", F.when(F.col("class") == unknown, F.lit(float("-inf"))).otherwise(F.col("score")))


def resolve_identity(preds: DataFrame, vocab: DataFrame) -> DataFrame:
    """Predicted ids as words: the identity keeps the old name, an unknown id is empty."""
    words = vocab.select(F.col("id").alias("pred_id"), "word")
    word = F.when(F.col("word") == "<IDENTITY>", F.col("old_name")).otherwise(F.coalesce("word", F.lit("")))
    return preds.join(words, "pred_id", "left").withColumn("pred_name", word).drop("word")


def reject_duplicate_names(hypotheses: DataFrame) -> DataFrame:
    """Hypotheses (func, hyp, pos, name, score) that give no two variables one name; functions left without any
    get hypothesis -1, the identity of every variable."""
    named = F.when(F.col("name") != "<IDENTITY>", F.col("name"))
    good = hypotheses.groupBy("func", "hyp").agg((F.count(named) == F.count_distinct(named)).alias("ok")).where("ok").select("func", "hyp")
    kept = hypotheses.join(good, ["func", "hyp"], "left_semi")
    none = hypotheses.join(good.select("func").distinct(), "func", "left_anti").select("func", "pos").distinct()
    return kept.unionByName(none.select("func", F.lit(-1).cast("long").alias("hyp"), "pos", F.lit("<IDENTITY>").alias("name"), F.lit(0.0).alias("score")))


def best_hypothesis(hypotheses: DataFrame) -> DataFrame:
    """The highest score of each function, the smaller hypothesis first among equals."""
    each = hypotheses.groupBy("func", "hyp").agg(F.max("score").alias("score"))
    return each.groupBy("func").agg(F.max_by("hyp", F.struct("score", -F.col("hyp"))).alias("hyp"), F.max("score").alias("score"))


def predict_with(rows: DataFrame, model: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """A user's function scores batches of rows."""
    return rows.mapInPandas(model, schema)
