"""Scores of predictions against ground truth, in slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def align(preds: DataFrame, ref: DataFrame) -> DataFrame:
    """Predictions beside the reference by (bin, func, pos); a missing one is empty."""
    joined = ref.join(preds, ["bin", "func", "pos"], "left")
    return joined.withColumns({"pred_type": F.coalesce("pred_type", F.lit("")), "pred_name": F.coalesce("pred_name", F.lit(""))})


def hit(pred: str, ref: str) -> Column:
    return (F.col(pred) == F.col(ref)).cast("int")


def rate(value: Column, where: Column | None = None) -> Column:
    """Mean over the rows that hold; null over none."""
    return F.round(F.avg(value if where is None else F.when(where, value)), 6)


def is_struct(column: str, rule: str = "word with blank") -> Column:
    """Whether the text starts with 'struct ', or by the other rules with 'struct'."""
    return F.col(column).startswith("struct " if rule == "word with blank" else "struct")


def need_rename() -> Column:
    return (F.col("old_name") != F.col("new_name")) & (F.col("new_name") != "")


def accuracy(rows: DataFrame, pred: str = "pred_type", ref: str = "tgt_type") -> DataFrame:
    return rows.agg(rate(hit(pred, ref)).alias("accuracy"))


def retype_report(rows: DataFrame) -> DataFrame:
    good, body, struct = hit("pred_type", "tgt_type"), F.col("body_in_train"), is_struct("tgt_type")
    return rows.agg(
        rate(good).alias("all"), rate(good, body).alias("body_in_train"), rate(good, ~body).alias("body_not_in_train"),
        rate(good, struct).alias("struct"), rate(good, struct & body).alias("struct_body_in_train"), rate(good, struct & ~body).alias("struct_body_not_in_train"),
    )


def rename_report(rows: DataFrame) -> DataFrame:
    good, body = hit("pred_name", "new_name"), F.col("body_in_train")
    return rows.where(need_rename()).agg(rate(good).alias("all"), rate(good, body).alias("body_in_train"), rate(good, ~body).alias("body_not_in_train"))


def macro_accuracy(rows: DataFrame, classes: int, pred: str = "pred_type", ref: str = "tgt_type") -> DataFrame:
    """Sum of the classes' recalls over the number of classes; absent classes count nought."""
    each = rows.groupBy(ref).agg(F.avg(hit(pred, ref)).alias("recall"))
    return each.agg(F.round(F.sum("recall") / F.lit(classes), 6).alias("macro_accuracy"))


def struct_macro(rows: DataFrame) -> DataFrame:
    """Mean recall of struct classes, over the struct classes that there are in the reference."""
    each = rows.where(is_struct("tgt_type")).groupBy("tgt_type").agg(F.avg(hit("pred_type", "tgt_type")).alias("recall"))
    return each.agg(F.round(F.sum("recall") / F.count("*"), 6).alias("struct_macro"))


def function_accuracy(rows: DataFrame) -> DataFrame:
    each = rows.groupBy("bin", "func").agg(F.min(hit("pred_type", "tgt_type")).alias("ok"))
    return each.agg(rate(F.col("ok")).alias("function_accuracy"))


def conditional(rows: DataFrame) -> DataFrame:
    """Rename accuracy where the type is right, and type accuracy where the name is."""
    name, kind = hit("pred_name", "new_name"), hit("pred_type", "tgt_type")
    return rows.agg(rate(name, kind == 1).alias("rename_given_retype"), rate(kind, name == 1).alias("retype_given_rename"))


def cross_conditional(groups: DataFrame) -> DataFrame:
    """Accuracy of a run where another is right, and the reverse; rows are groups of ``n`` variables, on which the runs are right or not."""
    share = lambda value, where: F.round(F.sum(F.when(where, F.when(value, F.col("n")).when(~value, 0))) / F.sum(F.when(where & value.isNotNull(), F.col("n"))), 6)
    own, other = F.col("own"), F.col("other")
    return groups.agg(share(own, other).alias("a_given_b"), share(other, own).alias("b_given_a"))


def edit_distance(pred: str, gold: str) -> Column:
    return F.levenshtein(F.col(pred), F.col(gold))


def cer(pred: str, gold: str) -> Column:
    return edit_distance(pred, gold) / F.greatest(F.char_length(gold), F.lit(1))


def corpus_columns(pred: str, gold: str, where: Column | None = None) -> dict[str, Column]:
    """Count, accuracy, mean distance, mean error rate, and the rate over the corpus; null over no rows."""
    on = (lambda c: c) if where is None else (lambda c: F.when(where, c))
    distance = edit_distance(pred, gold)
    return {
        "n": F.count(on(F.lit(1))),
        "accuracy": F.round(F.avg(on(hit(pred, gold))), 6),
        "distance": F.round(F.avg(on(distance)), 6),
        "cer": F.round(F.avg(on(cer(pred, gold))), 6),
        "corpus_cer": F.round(F.sum(on(distance)) / F.greatest(F.sum(on(F.char_length(gold))), F.lit(1)), 6),
    }


def corpus_metrics(rows: DataFrame, pred: str, gold: str) -> DataFrame:
    return rows.agg(*(c.alias(k) for k, c in corpus_columns(pred, gold).items()))


def soft_report(rows: DataFrame) -> DataFrame:
    """The corpus metrics of names in six slices, a row a slice; one pass over the variables."""
    slices = F.array(
        F.lit("all"),
        F.when(need_rename(), F.lit("need rename")),
        F.when(F.col("name_in_train"), F.lit("name in train")).otherwise(F.lit("name not in train")),
        F.when(F.col("body_in_train"), F.lit("body in train")).otherwise(F.lit("body not in train")),
    )
    each = rows.withColumn("slice", F.explode(slices)).where(F.col("slice").isNotNull())
    columns = corpus_columns("pred_name", "new_name")
    return each.groupBy("slice").agg(*(c.alias(k) for k, c in columns.items()), F.countDistinct("bin", "func").alias("functions"))


def evaluate_external(ref: DataFrame, preds: DataFrame) -> DataFrame:
    """Scores of another tool, by (bin, func, pos, pred_name); a function without a prediction keeps its old names."""
    joined = ref.join(preds.select("bin", "func", "pos", "pred_name"), ["bin", "func", "pos"], "left")
    filled = joined.withColumns({"had": F.col("pred_name"), "pred_name": F.coalesce("pred_name", "old_name")})
    done = F.countDistinct(F.when(F.col("had").isNotNull(), F.struct("bin", "func"))).alias("predicted_functions")
    return filled.agg(*(c.alias(k) for k, c in corpus_columns("pred_name", "new_name").items()), done)


def perplexity(logps: DataFrame, where: Column) -> DataFrame:
    return logps.where(where).agg(F.round(F.exp(-F.sum("logp") / (F.count("*") + 1e-12)), 6).alias("perplexity"))


def weighted_log_prob(logps: DataFrame, key: str) -> DataFrame:
    return logps.groupBy(key).agg(F.round(F.sum(F.col("weight") * F.col("logp")) / F.count("*"), 6).alias("log_prob"))


def changed_perplexities(logps: DataFrame) -> DataFrame:
    part = lambda changed: F.round(F.exp(-F.avg(F.when(F.col("changed") == changed, F.col("logp")))), 6)
    return logps.agg(part(True).alias("rename_ppl"), part(False).alias("unchanged_ppl"))


def mean_loss(logps: DataFrame) -> DataFrame:
    return logps.groupBy("task").agg(F.round(F.avg(-F.col("logp")), 6).alias("loss"))


def confusion_top(rows: DataFrame, types: int = 10, preds: int = 6) -> DataFrame:
    """The commonest true types, and the commonest predictions of each with their share, of rows whose body is new."""
    kept = rows.where(~F.col("body_in_train") & ~F.col("pred_type").isin("", "<unk>"))
    counts = kept.groupBy("tgt_type", "pred_type").agg(F.count("*").alias("n"))
    totals = counts.groupBy("tgt_type").agg(F.sum("n").alias("total"))
    top = totals.withColumn("type_rank", F.row_number().over(Window.orderBy(F.desc("total"), "tgt_type"))).where(F.col("type_rank") <= types)
    inner = Window.partitionBy("tgt_type").orderBy(F.desc("n"), "pred_type")
    ranked = counts.join(top, "tgt_type").withColumn("pred_rank", F.row_number().over(inner)).where(F.col("pred_rank") <= preds)
    return ranked.select("type_rank", "tgt_type", "total", "pred_rank", "pred_type", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def source_confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tgt_type", "src_type").agg(F.count("*").alias("n"))


def per_function_metrics(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bin", "func").agg(*(c.alias(k) for k, c in corpus_columns("pred_name", "new_name").items()))
