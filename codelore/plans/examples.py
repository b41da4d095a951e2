"""Queries over examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelore.operators import examples as E
from codelore.plans import views
from codelore.plans.register import query
from codelore.plans.text import COMMON
from codelore.plans.views import sql


def nested(spark, d):
    """Functions in the shape of their records: even variables arguments, odd ones locals, on both sides."""
    v = views.variables(spark, d)

    def side(name, kind):
        t, n = ("src_type", "old_name") if name == "c" else ("tgt_type", "new_name")
        entry = lambda x: F.struct(x["loc"], F.array(F.struct(x[t].alias("t"), x[n].alias("n"), x["user"].alias("u"))))
        return F.map_from_entries(F.transform(F.filter("vars", lambda x: x["pos"] % 2 == (0 if kind == "a" else 1)), entry)).alias(kind)

    rows = v.groupBy("bin", "func").agg(F.collect_list(F.struct("pos", "loc", "src_type", "tgt_type", "old_name", "new_name", "user")).alias("vars"))
    return rows.select("bin", "func", *(F.struct(side(n, "a"), side(n, "l")).alias(n) for n in "bc"))


@query("c1_flatten_variables", sql("""SELECT bin, func, 'c' AS side, CASE WHEN pos % 2 = 0 THEN 'a' ELSE 'l' END AS kind, loc, old_name AS name, src_type AS type_str, "user" FROM v2
    UNION ALL SELECT bin, func, 'b', CASE WHEN pos % 2 = 0 THEN 'a' ELSE 'l' END, loc, new_name, tgt_type, "user" FROM v2""", "v2"))
def c1(spark, d):
    return E.flatten_variables(nested(spark, d))


@query("c2_parse_location", sql("SELECT func, pos, CASE WHEN starts_with(loc, 's') THEN 'stack' ELSE 'register' END AS loc_kind, CAST(loc[2:] AS BIGINT) AS loc_value FROM v2", "v2"))
def c2(spark, d):
    kind, value = E.parse_location(F.col("loc"))
    return views.variables(spark, d).select("func", "pos", kind.alias("loc_kind"), value.alias("loc_value"))


@query("c3_merge_args_over_locals", sql("SELECT func, loc, 'l' AS kind, old_name AS name FROM v2 a WHERE NOT EXISTS (SELECT 1 FROM v2 b WHERE b.func = a.func AND b.loc = a.loc AND b.pos % 3 = 0) UNION ALL SELECT func, loc, 'a', new_name FROM v2 WHERE pos % 3 = 0", "v2"))
def c3(spark, d):
    local = F.struct(F.lit("l").alias("kind"), F.col("old_name").alias("name"))
    argument = F.struct(F.lit("a").alias("kind"), F.col("new_name").alias("name"))
    both = F.when(F.col("pos") % 3 == 0, F.array(local, argument)).otherwise(F.array(local))
    return E.merge_args_over_locals(views.variables(spark, d).select("func", "loc", F.inline(both)))


@query("c4_drop_shared_locations", "SELECT l_orderkey AS func, l_partkey % 5 AS loc, l_partkey AS name FROM lineitem JOIN (SELECT l_orderkey AS k, l_partkey % 5 AS m FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) = 1) ON k = l_orderkey AND m = l_partkey % 5")
def c4(spark, d):
    return E.drop_shared_locations(views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("func"), (F.col("l_partkey") % 5).alias("loc"), F.col("l_partkey").alias("name")))


@query("c5_keep_mentioned", f"SELECT doc_id AS func, w AS name FROM documents, ({COMMON}) WHERE list_contains(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), w)")
def c5(spark, d):
    tokens = views.table(spark, d, "documents").select(F.col("doc_id").alias("func"), F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("token"))
    words = tokens.groupBy("token").count().orderBy(F.desc("count"), "token").limit(20).select(F.col("token").alias("name"))
    variables = views.table(spark, d, "documents").select(F.col("doc_id").alias("func")).crossJoin(F.broadcast(words))
    return E.keep_mentioned(variables, tokens)


@query("c6_keep_target_in_source", "SELECT l_orderkey AS func, l_linenumber AS loc, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_linenumber <= 3")
def c6(spark, d):
    lines = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("func"), F.col("l_linenumber").alias("loc"), "l_partkey")
    orders = views.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("func"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("loc"))
    return E.keep_target_in_source(lines, orders)


@query("c7_fill_disappear", "SELECT c_custkey AS func, c_nationkey AS loc, coalesce(o_orderstatus, '') AS new_name, coalesce(o_orderpriority, 'disappear') AS tgt_type FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 25 = c_nationkey")
def c7(spark, d):
    source = views.table(spark, d, "customer").select(F.col("c_custkey").alias("func"), F.col("c_nationkey").cast("long").alias("loc"))
    target = views.table(spark, d, "orders").select(F.col("o_custkey").alias("func"), (F.col("o_orderkey") % 25).alias("loc"), F.col("o_orderstatus").alias("name"), F.col("o_orderpriority").alias("type_str"))
    return E.fill_disappear(source, target)


@query("c8_valid_functions", sql("SELECT DISTINCT func, func_name FROM v2 WHERE func % 3 <> 0 AND func IN (SELECT func FROM v2 WHERE padding)", "v2"))
def c8(spark, d):
    v = views.variables(spark, d)
    source = v.select("func", "func_name").distinct()
    target = source.withColumn("func_name", F.when(F.col("func") % 3 == 0, F.lit("other")).otherwise(F.col("func_name")))
    return E.valid_functions(source, target, v.where("padding"))


@query("c9_legacy_valid", sql("SELECT func FROM v2 GROUP BY func HAVING count(*) * 40 < 300 AND bool_or(old_name <> new_name)", "v2"))
def c9(spark, d):
    v = views.variables(spark, d)
    return E.legacy_valid(v, v.groupBy("func").agg((F.count("*") * 40).alias("size")))


@query("c10_need_rename", sql("SELECT func, pos FROM v2 WHERE old_name <> new_name AND new_name <> ''", "v2"))
def c10(spark, d):
    from codelore.operators import evaluate

    return views.variables(spark, d).where(evaluate.need_rename()).select("func", "pos")


@query("c11_collect_locations", "SELECT l_orderkey AS func, l_partkey AS name, CASE WHEN l_returnflag = 'R' THEN concat('r', l_linenumber) ELSE concat('s', 400 - (l_linenumber * 8 - l_suppkey)) END AS loc FROM lineitem WHERE l_partkey % 7 <> 0")
def c11(spark, d):
    rows = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("func"), F.when(F.col("l_partkey") % 7 != 0, F.col("l_partkey").cast("string")).alias("name"), F.col("l_shipdate").cast("string").alias("type_str"), (F.col("l_linenumber") * 8).alias("stkoff"), F.col("l_suppkey").alias("delta"), F.lit(400).alias("frame"), F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")).alias("register"))
    return E.collect_locations(rows).select("func", F.col("name").cast("long").alias("name"), "loc")


@query("c12_pair_debug_decompiled", "SELECT o_custkey AS bin, o_orderkey AS ea, o_orderstatus, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1")
def c12(spark, d):
    debug = views.table(spark, d, "orders").select(F.col("o_custkey").alias("bin"), F.col("o_orderkey").alias("ea"), "o_orderstatus")
    lines = views.table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("ea"), "l_partkey")
    decompiled = lines.join(views.table(spark, d, "orders").select(F.col("o_orderkey").alias("ea"), F.col("o_custkey").alias("bin")), "ea")
    return E.pair_debug_decompiled(debug, decompiled)


@query("c13_has_user_names", sql('SELECT func, bool_or("user") AS has_user_names FROM v2 GROUP BY func', "v2"))
def c13(spark, d):
    return E.has_user_names(views.variables(spark, d))


@query("c14_locations", sql("SELECT DISTINCT func, loc FROM v2", "v2"))
def c14(spark, d):
    twice = F.sequence(F.lit(0), F.when(F.col("pos") % 2 == 0, 1).otherwise(0))
    return E.locations(views.variables(spark, d).select("func", "loc", F.explode(twice)))


@query("c15_variable_name_map", sql("SELECT func, src_type AS old_name, arg_min(new_name, pos) AS new_name, min(pos) AS pos FROM v2 GROUP BY ALL", "v2"))
def c15(spark, d):
    return E.variable_name_map(views.variables(spark, d).select("func", F.col("src_type").alias("old_name"), "new_name", "pos"))


@query("c16_example_round_trip", sql("SELECT bin AS \"binary\", func_name AS name, count(*) AS variables, count(*) FILTER (tgt_type <> '') AS targets, func % 2 = 0 AS in_train FROM v2 GROUP BY bin, func, func_name", "v2"))
def c16(spark, d):
    v = views.variables(spark, d)
    side = lambda n, t: F.map_from_entries(F.collect_list(F.struct("loc", F.struct(F.col(n).alias("n"), F.col(t).alias("t")))))
    rows = v.groupBy(F.col("bin").alias("binary"), "func", F.col("func_name").alias("name")).agg(side("old_name", "src_type").alias("source"), side("new_name", "tgt_type").alias("target"), F.collect_list("old_name").alias("code_tokens"))
    meta = F.struct((F.col("func") % 2 == 0).alias("function_name_in_train"), F.lit(False).alias("function_body_in_train"))
    back = E.from_example(E.to_example(rows.withColumn("test_meta", meta)))
    return back.select("binary", "name", F.size("source").cast("long").alias("variables"), F.size("target").cast("long").alias("targets"), F.col("test_meta.function_name_in_train").alias("in_train"))
