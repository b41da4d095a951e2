"""Queries over statistics and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelore.functions import text as T
from codelore.operators import scores as I
from codelore.operators import splits
from codelore.operators import stats as S
from codelore.plans import views
from codelore.plans.evaluation import LOGPS, SCORES, V1_FLAGS, score_rows, v1_split
from codelore.plans.register import query
from codelore.plans.text import DOCS, tokens_sql
from codelore.plans.views import sql


@query("l1_length_stats", sql(f"""SELECT 'tokens' AS what, count(*) AS n, round(avg(len(t)), 6) AS mean, round(CAST(median(len(t)) AS DOUBLE), 6) AS median FROM ({tokens_sql(DOCS)})
    UNION ALL SELECT 'variables', count(*), round(avg(n), 6), round(CAST(median(n) AS DOUBLE), 6) FROM (SELECT count(*) AS n FROM v2 GROUP BY func)""", "v2"))
def l1(spark, d):
    tokens = views.functions(spark, d).select(F.size(T.tokenize_code(F.col("body"))).alias("n"))
    variables = views.variables(spark, d).groupBy("func").agg(F.count("*").alias("n"))
    return S.length_stats(tokens, "n").withColumn("what", F.lit("tokens")).unionByName(S.length_stats(variables, "n").withColumn("what", F.lit("variables"))).select("what", "n", "mean", "median")


@query("l2_unique_functions", f"SELECT count(DISTINCT concat(name, chr(1), array_to_string(t, ' '))) AS unique_functions FROM ({tokens_sql(DOCS)}) JOIN (SELECT doc_id AS id, CASE WHEN n_chars % 5 = 0 THEN concat('u', doc_id) ELSE lang END AS name FROM documents) USING (id)")
def l2(spark, d):
    return S.unique_functions(views.functions(spark, d).select("name", T.tokenize_code(F.col("body")).alias("tokens")))


@query("l3_unique_binaries", "SELECT count(DISTINCT source) AS unique_binaries FROM documents")
def l3(spark, d):
    return S.unique_binaries(views.functions(spark, d))


def mi_sql(source: str) -> str:
    return f"""WITH t AS (SELECT x, y, count(*) AS n FROM ({source}) GROUP BY ALL), a AS (SELECT x, sum(n) AS a FROM t GROUP BY x), b AS (SELECT y, sum(n) AS b FROM t GROUP BY y), z AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM t),
    mi AS (SELECT sum(n / total * ln(n * total / (a * b))) AS mi FROM t JOIN a USING (x) JOIN b USING (y), z), ha AS (SELECT -sum(a / total * ln(a / total)) AS ha FROM a, z), hb AS (SELECT -sum(b / total * ln(b / total)) AS hb FROM b, z),
    e AS (SELECT sum(k / total * ln(total * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(total - a + 1) + lgamma(total - b + 1) - lgamma(total + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(total - a - b + k + 1))) AS emi
        FROM (SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, total, CAST(unnest(range(CAST(greatest(1, a + b - total) AS BIGINT), CAST(least(a, b) AS BIGINT) + 1)) AS DOUBLE) AS k FROM a, b, z))
    SELECT round(mi, 6) AS mi, round(mi / ((ha + hb) / 2), 6) AS nmi, round((mi - emi) / ((ha + hb) / 2 - emi), 6) AS ami FROM mi, ha, hb, e"""


@query("l4_mutual_information", mi_sql("SELECT o_orderpriority AS x, o_orderstatus AS y FROM orders"))
def l4(spark, d):
    return S.mutual_information(views.table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


@query("l5_shuffled_mutual_information", mi_sql("""SELECT p.x, q.y FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS i, o_orderpriority AS x FROM orders) p
    JOIN (SELECT row_number() OVER (ORDER BY sha256(concat('7:', o_orderkey)), o_orderkey) AS i, o_orderstatus AS y FROM orders) q USING (i)"""))
def l5(spark, d):
    rows = views.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return S.mutual_information(S.shuffled(rows, "o_orderkey", "o_orderstatus", "7"), "o_orderpriority", "o_orderstatus")


@query("l6_legacy_stats", sql("""SELECT split, round(avg(v + 1), 6) AS tree_size, round(avg(v), 6) AS variables, round(avg(r), 6) AS renamed FROM (
    SELECT split, func, count(*) AS v, sum(CAST(old_name <> new_name AS INT)) AS r FROM v2 JOIN parts USING (bin) GROUP BY ALL) GROUP BY split""", "parts"))
def l6(spark, d):
    v = views.variables(spark, d)
    trees = v.groupBy("func").agg((F.count("*") + 1).alias("size"))
    return S.legacy_stats(v.join(views.split(v), "bin"), trees)


@query("l7_split_counts", V1_FLAGS + "SELECT split, count(DISTINCT bin) AS bins, count(*) AS functions, CAST(ceil(count(DISTINCT bin) / 3) AS BIGINT) AS shards FROM v1 JOIN s USING (bin) GROUP BY split")
def l7(spark, d):
    return S.split_counts(v1_split(spark, d), 3)


@query("l8_leakage_rate", V1_FLAGS + "SELECT split, round(avg(CAST(EXISTS (SELECT 1 FROM t WHERE t.func_name = v1.func_name AND t.body = v1.body) AS INT)), 6) AS leakage FROM v1 JOIN s USING (bin) WHERE split <> 'train' GROUP BY split")
def l8(spark, d):
    return S.leakage_rate(splits.annotate_split(v1_split(spark, d)))


WORDS = "SELECT w AS word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM documents) GROUP BY w"


def word_counts(spark, d):
    return views.table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


@query("l9_vocab_report", f"SELECT word, freq, row_number() OVER (ORDER BY freq DESC, word) AS rank, (SELECT count(*) FROM ({WORDS})) AS words, (SELECT count(*) FROM ({WORDS}) WHERE freq >= 5) AS over_cutoff FROM ({WORDS}) ORDER BY freq DESC, word LIMIT 30")
def l9(spark, d):
    return S.vocab_report(word_counts(spark, d), 5)


@query("l10_dataset_size", "SELECT count(*) AS examples FROM documents")
def l10(spark, d):
    return S.dataset_size(views.functions(spark, d))


@query("i1_add_layout_scores", f"SELECT item, class, round(CAST(score AS DOUBLE) + CAST(embedding[class + 11] AS DOUBLE), 6) AS score FROM ({SCORES}) JOIN embeddings ON vec_id = item")
def i1(spark, d):
    e = views.table(spark, d, "embeddings")
    layout = e.select(F.col("vec_id").alias("item"), F.posexplode(F.slice("embedding", 11, 10)).alias("class", "score")).withColumn("class", F.col("class").cast("long"))
    return I.add_layout_scores(score_rows(spark, d), layout.withColumn("score", F.col("score").cast("double"))).withColumn("score", F.round("score", 6))


@query("i2_top_k", f"SELECT item, class, rank FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, class) AS rank FROM ({SCORES})) WHERE rank <= 3")
def i2(spark, d):
    return I.top_k(score_rows(spark, d), 3).select("item", "class", "rank")


@query("i3_log_softmax", f"SELECT item, class, round(logp, 6) AS log_prob FROM {LOGPS}")
def i3(spark, d):
    return I.log_softmax(score_rows(spark, d)).select("item", "class", F.round("log_prob", 6).alias("log_prob"))


@query("i4_ensemble_logsumexp", f"SELECT item // 2 AS item, class, round(ln(sum(exp(CAST(score AS DOUBLE)))), 6) AS score FROM ({SCORES}) GROUP BY 1, 2")
def i4(spark, d):
    rows = score_rows(spark, d).select((F.col("item") % 2).alias("model"), F.floor(F.col("item") / 2).alias("item"), "class", "score")
    return I.ensemble_logsumexp(rows).withColumn("score", F.round("score", 6))


@query("i5_suppress_unknown", f"SELECT item, class FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, class) AS rank FROM ({SCORES}) WHERE class <> 3) WHERE rank = 1")
def i5(spark, d):
    return I.top_k(I.suppress_unknown(score_rows(spark, d), 3)).select("item", "class")


@query("i6_resolve_identity", sql("SELECT func, pos, CASE WHEN pos % 4 = 0 THEN old_name WHEN pos % 4 = 1 THEN 'count' WHEN pos % 4 = 2 THEN 'index' ELSE '' END AS pred_name FROM v2", "v2"))
def i6(spark, d):
    vocab = spark.createDataFrame([(0, "<IDENTITY>"), (1, "count"), (2, "index")], "id long, word string")
    return I.resolve_identity(views.variables(spark, d).withColumn("pred_id", F.col("pos") % 4), vocab).select("func", "pos", "pred_name")


HYPOTHESES = "SELECT func, pos, h AS hyp, CASE h WHEN 0 THEN new_name WHEN 1 THEN concat(new_name, pos % 3) ELSE '<IDENTITY>' END AS name, CAST((func * 7 + h * 5) % 11 AS DOUBLE) AS score FROM v2, (SELECT unnest(range(0, CASE WHEN true THEN 2 END)) AS h)"
GOOD = f"h AS ({HYPOTHESES}), g AS (SELECT func, hyp FROM h GROUP BY func, hyp HAVING count(*) FILTER (name <> '<IDENTITY>') = count(DISTINCT name) FILTER (name <> '<IDENTITY>'))"


def hypotheses(spark, d):
    v = views.variables(spark, d).withColumn("hyp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    name = F.when(F.col("hyp") == 0, F.col("new_name")).otherwise(F.concat("new_name", F.col("pos") % 3))
    return v.select("func", "pos", "hyp", name.alias("name"), ((F.col("func") * 7 + F.col("hyp") * 5) % 11).cast("double").alias("score"))


@query("i7_reject_duplicate_names", sql("", "v2") + f", {GOOD} SELECT h.func, h.hyp, pos, name, score FROM h JOIN g ON g.func = h.func AND g.hyp = h.hyp UNION ALL SELECT DISTINCT func, -1, pos, '<IDENTITY>', 0.0 FROM h WHERE func NOT IN (SELECT func FROM g)")
def i7(spark, d):
    return I.reject_duplicate_names(hypotheses(spark, d)).select("func", "hyp", "pos", "name", "score")


@query("i8_best_hypothesis", sql("", "v2") + f", h AS ({HYPOTHESES}) SELECT func, hyp, score FROM (SELECT func, hyp, score, row_number() OVER (PARTITION BY func ORDER BY score DESC, hyp) AS rn FROM (SELECT DISTINCT func, hyp, score FROM h)) WHERE rn = 1")
def i8(spark, d):
    return I.best_hypothesis(hypotheses(spark, d))


@query("i9_predict_with", "SELECT vec_id AS item, CAST(list_position(list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)), list_max(list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)))) - 1 AS BIGINT) AS class FROM embeddings")
def i9(spark, d):
    def model(frames):
        import numpy as np

        for frame in frames:
            best = np.array([np.argmax(x[:10]) for x in frame["embedding"]], np.int64)
            yield frame[["item"]].assign(**{"class": best})

    return I.predict_with(views.table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), "embedding"), model, "item long, class long")
