"""Queries over features and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelore.operators import features as X
from codelore.plans import views
from codelore.plans.register import query
from codelore.plans.text import COMMON, MARKED, marked
from codelore.plans.views import sql


def names(spark, d):
    """Each document's marked pieces, with the 20 common words as its variables, numbered by name."""
    pieces = marked(spark, d).select(F.col("doc_id").alias("key"), F.col("tokens").alias("pieces"))
    words = views.table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(20)
    return pieces, words.agg(F.array_sort(F.collect_list("w")).alias("names"))


@query("g1_order_variables", f"""SELECT doc_id AS key, w AS name, place, rank FROM (SELECT doc_id, w, place, row_number() OVER (PARTITION BY doc_id ORDER BY place, w) AS rank FROM (
    SELECT doc_id, w, CAST(coalesce(list_position(t, concat('@@', w, '@@')), len(t) + 1) AS BIGINT) AS place FROM ({MARKED}), ({COMMON}))) WHERE rank <= 4""")
def g1(spark, d):
    pieces, words = names(spark, d)
    return X.order_variables(pieces.crossJoin(F.broadcast(words)), 4)


@query("g2_variable_features", sql("SELECT func, string_agg(old_name, ' ' ORDER BY pos) AS old_names, string_agg(tgt_type, '|' ORDER BY pos) AS types, string_agg(CAST(size AS VARCHAR), ',' ORDER BY pos) AS sizes FROM v2 GROUP BY func", "v2"))
def g2(spark, d):
    rows = X.variable_features(views.variables(spark, d), ["old_name", "tgt_type", "size"])
    return rows.select("func", F.array_join("old_name", " ").alias("old_names"), F.array_join("tgt_type", "|").alias("types"), F.array_join(F.transform("size", lambda x: x.cast("string")), ",").alias("sizes"))


MENTIONS = f"SELECT doc_id AS key, i - 1 AS pos, t[i] AS piece FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM ({MARKED})) WHERE starts_with(t[i], '@@') AND t[i] IN (SELECT concat('@@', w, '@@') FROM ({COMMON}))"
NUMBERED = f"SELECT w, row_number() OVER (ORDER BY w) - 1 AS var FROM ({COMMON})"


def mentions(spark, d):
    pieces, words = names(spark, d)
    variables = pieces.select("key").crossJoin(F.broadcast(words)).select("key", F.posexplode("names").alias("var", "name")).withColumn("var", F.col("var").cast("long"))
    return variables, X.mention_positions(pieces, variables)


@query("g3_mention_positions", f"SELECT key, pos, var FROM ({MENTIONS}) JOIN ({NUMBERED}) ON piece = concat('@@', w, '@@')")
def g3(spark, d):
    return mentions(spark, d)[1]


@query("g4_mention_counts", f"""SELECT doc_id AS key, var, coalesce(n, 0) AS mentions, coalesce(n, 0) > 0 AS seen, greatest(coalesce(n, 0), 1) AS legacy FROM documents CROSS JOIN ({NUMBERED}) v
    LEFT JOIN (SELECT key, piece, count(*) AS n FROM ({MENTIONS}) GROUP BY ALL) m ON m.key = doc_id AND m.piece = concat('@@', w, '@@')""")
def g4(spark, d):
    return X.mention_counts(*mentions(spark, d))


@query("g5_pad_batch", sql("""SELECT func // 16 AS batch, func AS key, concat(ids, repeat(',0', CAST(max(n) OVER (PARTITION BY func // 16) - n AS INT))) AS ids, n AS unmasked FROM (
    SELECT func, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS ids, count(*) AS n FROM v2 GROUP BY func)""", "v2"))
def g5(spark, d):
    rows = X.variable_features(views.variables(spark, d).withColumn("id", F.col("pos")), ["id"]).select(F.floor(F.col("func") / 16).alias("batch"), F.col("func").alias("key"), F.col("id").alias("ids"))
    out = X.pad_batch(rows)
    return out.select("batch", "key", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), F.size(F.filter("mask", lambda m: m)).cast("long").alias("unmasked"))


@query("g6_prediction_targets", sql("""SELECT func, pos, changed, CAST(CASE WHEN changed THEN 1.0 ELSE 0.1 END AS DOUBLE) AS weight, i - 1 AS piece_pos, p[i] AS piece FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM (
    SELECT func, pos, old_name <> new_name AS changed, CASE WHEN old_name = new_name THEN ['<IDENTITY>', '</s>'] ELSE list_append(string_split(new_name, '_'), '</s>') END AS p FROM v2))""", "v2"))
def g6(spark, d):
    return X.prediction_targets(views.variables(spark, d), 0.1).withColumn("piece_pos", F.col("piece_pos").cast("long"))


@query("g7_interleave_targets", sql("SELECT func, 2 * pos AS at, size AS id FROM v2 UNION ALL SELECT func, 2 * pos + 1, pos % 7 + 50 FROM v2", "v2"))
def g7(spark, d):
    v = views.variables(spark, d).select("func", "pos", F.col("size").alias("type_id"), (F.col("pos") % 7).alias("name_id"))
    return X.interleave_targets(v, 50)


BUCKETS = "SELECT doc_id, n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS bucket FROM documents"


def buckets(spark, d):
    return X.length_buckets(views.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 64)


@query("g8_length_buckets", f"SELECT doc_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY n_chars, doc_id) - 1 AS place FROM ({BUCKETS})")
def g8(spark, d):
    return buckets(spark, d).select("doc_id", "bucket", "place")


@query("g9_token_budget_batches", f"""WITH RECURSIVE o AS (SELECT bucket, n_chars, row_number() OVER (PARTITION BY bucket ORDER BY n_chars, doc_id) - 1 AS place FROM ({BUCKETS})),
    r AS (SELECT bucket, place, n_chars AS length, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS c, n_chars AS longest FROM o WHERE place = 0
    UNION ALL SELECT o.bucket, o.place, o.n_chars, CASE WHEN (c + 1) * greatest(longest, o.n_chars) > 20000 THEN batch + 1 ELSE batch END, CASE WHEN (c + 1) * greatest(longest, o.n_chars) > 20000 THEN 1 ELSE c + 1 END,
        CASE WHEN (c + 1) * greatest(longest, o.n_chars) > 20000 THEN o.n_chars ELSE greatest(longest, o.n_chars) END FROM r JOIN o ON o.bucket = r.bucket AND o.place = r.place + 1)
    SELECT bucket, place, length, batch FROM r""")
def g9(spark, d):
    return X.token_budget_batches(buckets(spark, d).withColumnRenamed("n_chars", "length"), 20000)


FIXED = "SELECT doc_id, n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch FROM documents"


@query("g10_fixed_batches", f"SELECT doc_id, batch FROM ({FIXED})")
def g10(spark, d):
    return X.fixed_batches(views.table(spark, d, "documents").select("doc_id"), "doc_id", 32).select("doc_id", "batch")


@query("g11_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY sha256(concat('5:', doc_id)), doc_id) - 1 AS n FROM documents")
def g11(spark, d):
    return X.shuffle(views.table(spark, d, "documents").select("doc_id"), "doc_id", "5")


VECTORS = "SELECT vec_id, label, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"


def vectors(spark, d):
    return views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))


def rounded(df):
    return df.withColumns({"x": F.round("x", 6), "dim": F.col("dim").cast("long")})


@query("g12_pool_mentions", f"SELECT label, dim, round(avg(x), 6) AS x FROM ({VECTORS}) GROUP BY ALL")
def g12(spark, d):
    return rounded(X.pool_mentions(vectors(spark, d), "label"))


@query("g13_masked_mean", f"SELECT vec_id // 4 AS key, dim, round(avg(x), 6) AS x FROM ({VECTORS}) WHERE vec_id % 3 <> 0 GROUP BY ALL")
def g13(spark, d):
    v = vectors(spark, d)
    lists = v.groupBy(F.floor(F.col("id") / 4).alias("key")).agg(F.collect_list(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("ids"))
    return rounded(X.masked_mean(lists, v.select("id", "vector")))


@query("g14_neighbour_mean", f"SELECT e.dst, v.dim, round(sum(v.x) / (max(g.n) + 1e-7), 6) AS x FROM (SELECT vec_id AS src, vec_id + 1 AS dst FROM embeddings UNION ALL SELECT vec_id, vec_id // 2 FROM embeddings) e JOIN ({VECTORS}) v ON v.vec_id = e.src JOIN (SELECT dst, count(*) AS n FROM (SELECT vec_id + 1 AS dst FROM embeddings UNION ALL SELECT vec_id // 2 FROM embeddings) GROUP BY dst) g USING (dst) GROUP BY e.dst, v.dim")
def g14(spark, d):
    v = vectors(spark, d)
    edges = v.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).union(v.select("id", F.floor(F.col("id") / 2)))
    return rounded(X.neighbour_mean(edges, v.select("id", "vector")))


@query("g15_padded_cost", f"SELECT CAST(sum(cost) AS BIGINT) AS cost, count(*) AS batches FROM (SELECT count(*) * max(n_chars) AS cost FROM ({FIXED}) GROUP BY batch)")
def g15(spark, d):
    return X.padded_cost(X.fixed_batches(views.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", 32), "n_chars")
