"""Queries over scans, sources and sinks."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from codelore.functions import text as T
from codelore.operators import evaluate
from codelore.operators.lineage import cut
from codelore.plans import views
from codelore.plans.evaluation import RETYPE
from codelore.plans.register import query
from codelore.plans.text import DOCS, tokens_sql
from codelore.plans.views import sql
from codelore.sources import scans as S
from codelore.sources import shards as P


def folder(spark, name):
    """A new place in the shared folder of the session."""
    cut(spark.range(1))  # sets the folder where the session names none
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid4().hex}"


@query("a1_scan_functions", "SELECT source AS bin, doc_id, sha256(text) AS digest FROM documents")
def a1(spark, d):
    path = folder(spark, "functions")
    rows = views.table(spark, d, "documents").select("source", "doc_id", F.to_json(F.struct("doc_id", "text")).alias("value"))
    # By ranges, so that a source with many rows is written and read by several tasks.
    rows.repartitionByRange("source", "doc_id").drop("doc_id").write.partitionBy("source").option("compression", "gzip").text(path)
    lines = S.scan_functions(spark, path)
    x = F.from_json("json", "doc_id long, text string")
    return lines.select(F.regexp_extract("file", "source=([^/]+)/", 1).alias("bin"), x.alias("x")).select("bin", "x.doc_id", F.sha2("x.text", 256).alias("digest"))


LISTED = "SELECT concat(source, CASE WHEN row_number() OVER (ORDER BY source) % 3 = 0 THEN '.txt' ELSE '.gz' END) AS name, row_number() OVER (ORDER BY source) AS place FROM (SELECT DISTINCT source FROM documents)"


@query("a2_select_inputs", f"SELECT name FROM ({LISTED}) WHERE ends_with(name, '.gz') AND name <> 'src1.gz' ORDER BY place LIMIT 5")
def a2(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("source"))
    bins = views.table(spark, d, "documents").select("source").distinct().withColumn("place", place)
    listed = bins.select(F.concat("source", F.when(F.col("place") % 3 == 0, ".txt").otherwise(".gz")).alias("name"), "place").where("name <> 'src1.gz'")
    return S.select_inputs(listed.select("name"), listed, 5)


BAD = "CASE WHEN event_id % 4 = 0 THEN props || '}' WHEN event_id % 7 = 0 THEN 'x' || props ELSE props END"


@query("a3_drop_malformed", "SELECT event_id FROM events WHERE event_id % 4 <> 0 AND event_id % 7 <> 0")
def a3(spark, d):
    return S.drop_malformed(views.table(spark, d, "events").select("event_id", F.expr(BAD).alias("json")), "json")[0].select("event_id")


@query("a4_readable_lines")
def a4(spark, d):
    path = folder(spark, "lines")
    views.table(spark, d, "events").select(F.col("props").alias("value")).write.option("compression", "gzip").text(path)
    return S.skip_corrupt_files(spark, path)[0].select("line_no", "json")


@query("a5_binary_key", "SELECT c_custkey, string_split(replace(c_name, '#', '_'), '_')[1] AS prefix, (c_name || repeat('x', 80))[1:64] AS hash, c_name AS bare FROM customer")
def a5(spark, d):
    file = F.translate("c_name", "#", "_")
    return views.table(spark, d, "customer").select("c_custkey", S.binary_key(file).alias("prefix"), S.binary_key(F.concat("c_name", F.repeat(F.lit("x"), 80)), "hash").alias("hash"), S.binary_key(F.concat("c_name", F.lit(".gz")), "name").alias("bare"))


#: Members of an archive.
MEMBERS = 64


def shards(spark, d):
    """The folder of the documents' shards."""
    text = F.concat(F.to_json(F.struct("doc_id", "n_chars", "text")), F.lit("\n\n"), F.to_json(F.struct("lang")))
    path = folder(spark, "shards")
    P.write_shards(views.table(spark, d, "documents").select(F.floor(F.col("doc_id") / MEMBERS).alias("shard"), F.concat("doc_id", F.lit(".jsonl")).alias("member"), text.alias("text")), path)
    return path


SHARD_LINES = "SELECT CAST(doc_id AS VARCHAR) AS member, 0 AS line_no, concat('{\"doc_id\":', doc_id, ',\"n_chars\":', n_chars, ',\"text\":', to_json(text), '}') AS json FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR), 2, concat('{\"lang\":\"', lang, '\"}') FROM documents"


@query("a6_scan_shards", SHARD_LINES)
def a6(spark, d):
    return P.scan_shards(spark, shards(spark, d)).drop("path")


@query("a7_group_by_binary", f"SELECT member, string_agg(json, '|' ORDER BY line_no) AS lines FROM ({SHARD_LINES}) GROUP BY member")
def a7(spark, d):
    return S.group_by_binary(P.scan_shards(spark, shards(spark, d))).select("member", F.array_join("lines", "|").alias("lines"))


@query("a8_shard_prefix", "SELECT shard FROM (SELECT source AS shard, row_number() OVER (ORDER BY source) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) WHERE rn <= floor(n * 0.35)")
def a8(spark, d):
    return S.shard_prefix(views.table(spark, d, "documents").select(F.col("source").alias("shard")).distinct(), 0.35)


@query("a9_assign_shards", sql("SELECT bin, split, CASE WHEN split = 'train' THEN (row_number() OVER (PARTITION BY split ORDER BY bin) - 1) // 7 ELSE 0 END AS shard_id FROM parts", "parts"))
def a9(spark, d):
    return S.assign_shards(views.split(views.variables(spark, d)), 7)


@query("a9_write_shards", sql("""SELECT concat(split, '-', CASE WHEN split = 'train' THEN (rn - 1) // 7 ELSE 0 END) AS shard, v2.bin AS member, row_number() OVER (PARTITION BY v2.bin ORDER BY func, pos) - 1 AS line_no,
    concat('{"func":', func, ',"pos":', pos, '}') AS json FROM v2 JOIN (SELECT *, row_number() OVER (PARTITION BY split ORDER BY bin) AS rn FROM parts) p ON p.bin = v2.bin""", "v2", "parts"))
def a9_written(spark, d):
    v, path = views.variables(spark, d), folder(spark, "shards")
    # A function's lines are a piece of its binary's member, so that no row grows with the table; binaries are 100 at every size.
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("func", "pos"))), lambda x: F.concat(F.to_json(x), F.lit("\n"))), "")
    pieces = v.groupBy("bin", "func").agg(lines.alias("text"))
    rows = pieces.join(F.broadcast(S.assign_shards(views.split(v), 7)), "bin")
    P.write_shards(rows.select(F.concat("split", F.lit("-"), "shard_id").alias("shard"), F.concat("bin", F.lit(".jsonl")).alias("member"), "text", F.col("func").alias("piece")), path)
    # No pattern that begins anew at every character of the path, line by line.
    shard = F.replace(F.substring_index("path", "/", -1), F.lit(".tar"))
    return P.scan_shards(spark, path).select(shard.alias("shard"), "member", "line_no", "json")


def library_lines(spark, d):
    """The part library, in two halves, as lines of its format."""
    p = views.table(spark, d, "part").groupBy((F.col("p_partkey") % 2).alias("lib"), F.col("p_size").cast("long").alias("size"), "p_type").agg(F.count("*").alias("freq"))
    return S.write_typelib(p.select("lib", "size", "freq", F.to_json(F.struct(F.lit(1).alias("T"), F.col("p_type").alias("n"), F.col("size").alias("s"))).alias("type_json")))


ENTRY = "concat('{\"T\":1,\"n\":\"', p_type, '\",\"s\":', p_size, '}')"


@query("a10_read_typelib", f"SELECT CAST(p_size AS BIGINT) AS size, count(*) AS freq, {ENTRY} AS type_json FROM part GROUP BY p_partkey % 2, p_size, p_type")
def a10(spark, d):
    return S.read_typelib(library_lines(spark, d))


@query("a11_write_typelib", f"""SELECT lib, '{{' || string_agg('"' || size || '":[' || e || ']', ',' ORDER BY size) || ',"T":0}}' AS json FROM (SELECT lib, size, string_agg('[' || freq || ',' || t || ']', ',' ORDER BY freq DESC, t) AS e FROM (
    SELECT p_partkey % 2 AS lib, p_size AS size, count(*) AS freq, {ENTRY} AS t FROM part GROUP BY p_partkey % 2, p_size, p_type) GROUP BY lib, size) GROUP BY lib""")
def a11(spark, d):
    return library_lines(spark, d)


@query("a12_load_typelib_dir", f"SELECT CAST(p_size AS BIGINT) AS size, {ENTRY} AS type_json, count(*) AS freq FROM part GROUP BY p_size, p_type")
def a12(spark, d):
    path = folder(spark, "typelib")
    library_lines(spark, d).select(F.col("json").alias("value")).write.text(path)
    return S.load_typelib_dir(spark, path)


PREDICTIONS = "SELECT bin, CAST(func AS VARCHAR) AS func, old_name AS var, tgt_type AS pred_type, new_name AS pred_name FROM v2"


def predictions(spark, d):
    v = views.variables(spark, d).select("bin", "func", F.col("old_name").alias("var"), "pos", F.explode(F.array(F.lit("early"), F.col("tgt_type"))).alias("pred_type"), F.col("new_name").alias("pred_name"))
    return S.write_predictions(v.withColumn("place", F.col("pos") + F.when(F.col("pred_type") == "early", 0).otherwise(1000)), "place")


@query("a13_write_predictions", sql("SELECT bin, CAST(count(DISTINCT func) AS BIGINT) AS functions FROM v2 GROUP BY bin", "v2"))
def a13(spark, d):
    return predictions(spark, d).select("bin", F.size(F.from_json("json", "map<string,string>")).cast("long").alias("functions"))


@query("a14_read_predictions", sql(PREDICTIONS, "v2"))
def a14(spark, d):
    return S.read_predictions(predictions(spark, d))


@query("a15_save_load_vocab", "SELECT 'types' AS vocab, p_type AS word, count(*) AS freq FROM part GROUP BY ALL UNION ALL SELECT 'brands', p_brand, count(*) FROM part GROUP BY ALL")
def a15(spark, d):
    p, path = views.table(spark, d, "part"), folder(spark, "vocab")
    count = lambda name, c: p.groupBy(F.lit(name).alias("vocab"), F.col(c).alias("word")).agg(F.count("*").alias("freq"))
    S.save_vocab(count("types", "p_type").unionByName(count("brands", "p_brand")), path)
    return S.load_vocab(spark, path).select("vocab", "word", "freq")


@query("a16_list_elf64", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def a16(spark, d):
    start = F.when(F.col("doc_id") % 3 == 0, F.expr("X'7F454C4602'")).when(F.col("doc_id") % 3 == 1, F.expr("X'7F454C4601'")).otherwise(F.expr("X'00'"))
    files = views.table(spark, d, "documents").select("doc_id", F.concat(start, F.encode("text", "UTF-8")).alias("content"))
    return S.list_elf64(files).select("doc_id")


@query("a17_content_key", "SELECT doc_id, concat(sha256(text), '_', source) AS key FROM documents")
def a17(spark, d):
    return views.table(spark, d, "documents").select("doc_id", S.content_key(F.col("text"), F.col("source")).alias("key"))


@query("a18_exact_dedup", "SELECT sha256(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def a18(spark, d):
    return S.exact_dedup(views.table(spark, d, "documents"), "text", "doc_id")


@query("a19_skip_done", "SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)")
def a19(spark, d):
    return S.skip_done(views.table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), views.table(spark, d, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("key")), "key")


@query("a20_token_lines", f"SELECT sha256(array_to_string(t, ' ')) AS digest FROM ({tokens_sql(DOCS)})")
def a20(spark, d):
    return S.token_lines(views.functions(spark, d).select(T.tokenize_code(F.col("body")).alias("tokens"))).select(F.sha2("value", 256).alias("digest"))


@query("a21_export_name_freq", sql("SELECT new_name AS name, count(*) AS freq FROM v2 GROUP BY 1", "v2"))
def a21(spark, d):
    path = folder(spark, "names")
    S.export_name_freq(views.variables(spark, d), path)
    return spark.read.schema("name string, freq long").csv(path, sep="\t")


@query("a22_export_names", sql("SELECT new_name AS value FROM v2 WHERE old_name <> new_name UNION ALL SELECT DISTINCT func_name FROM v2", "v2"))
def a22(spark, d):
    v = views.variables(spark, d)
    return S.export_names(v, v.select(F.col("func_name").alias("identifier")).distinct())


@query("a23_json_archive_to_lines", "SELECT concat(doc_id, '.json') AS member, concat('{\"id\":', doc_id, ',\"lang\":\"', lang, '\",\"text\":', to_json(text), '}') AS json FROM documents")
def a23(spark, d):
    text = F.concat(F.lit('{ "id": '), "doc_id", F.lit(',\n  "lang": "'), "lang", F.lit('",\n  "text": '), F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', 1), F.lit("\n}"))
    path = folder(spark, "archives")
    P.write_shards(views.table(spark, d, "documents").select(F.floor(F.col("doc_id") / MEMBERS).alias("shard"), F.concat("doc_id", F.lit(".json")).alias("member"), text.alias("text")), path)
    return S.json_archive_to_lines(P.scan_members(spark, path))


@query("a24_subsample_binaries", "SELECT bin FROM (SELECT bin, row_number() OVER (ORDER BY sha256(concat('9:', bin)), bin) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT source AS bin FROM documents)) WHERE rn <= floor(n * 0.3)")
def a24(spark, d):
    return S.subsample_binaries(views.table(spark, d, "documents").select(F.col("source").alias("bin")).distinct(), 0.3, "9")


@query("a25_write_metrics", sql(RETYPE, "v7"))
def a25(spark, d):
    report = evaluate.retype_report(views.scored(spark, d))
    return S.metrics_json(report).select(F.from_json("value", report.schema).alias("x")).select("x.*")
