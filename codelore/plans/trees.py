"""Queries over trees and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelore.operators import trees as H
from codelore.operators import vocab as V
from codelore.plans import views
from codelore.plans.register import query
from codelore.plans.vocab import vocab_sql
from codelore.plans.views import sql

EDGES = "SELECT tree, parent AS src, node_id AS dst FROM v5 WHERE parent IS NOT NULL"
LEAVES = "SELECT v.tree, v.node_id FROM v5 v LEFT JOIN (SELECT tree, parent FROM v5 WHERE parent IS NOT NULL GROUP BY ALL) u ON u.tree = v.tree AND u.parent = v.node_id WHERE u.parent IS NULL"
MENTIONS = "SELECT user_id AS tree, event_type AS variable, ts, event_id AS node_id FROM events"


def both(edges: str) -> str:
    return f"SELECT tree, src, dst FROM ({edges}) UNION ALL SELECT tree, dst, src FROM ({edges})"


@query("h1_flatten_ast", """SELECT o_orderkey AS tree, 0 AS node_id, CAST(NULL AS BIGINT) AS parent, 'root' AS role, 'block' AS opcode, concat('{"priority":"', o_orderpriority, '"}') AS payload FROM orders
    UNION ALL SELECT o_orderkey, 1, 0, 'x', 'asg', '{}' FROM orders UNION ALL SELECT o_orderkey, 2, 1, 'x', 'var', concat('{"n":"', o_orderstatus, '"}') FROM orders UNION ALL SELECT o_orderkey, 3, 1, 'y', 'num', concat('{"v":', o_custkey, '}') FROM orders
    UNION ALL SELECT o_orderkey, 4, 0, 'children', 'return', '{}' FROM orders UNION ALL SELECT o_orderkey, 5, 4, 'x', 'var', concat('{"n":"', o_orderstatus, '"}') FROM orders""")
def h1(spark, d):
    node = lambda i, kind, *more: F.struct(F.lit(i).alias("id"), F.lit(kind).alias("M"), *more)
    name = F.col("o_orderstatus").alias("n")
    assign = node(1, "asg", node(2, "var", name).alias("x"), node(3, "num", F.col("o_custkey").alias("v")).alias("y"))
    back = node(4, "return", node(5, "var", name).alias("x"))
    tree = F.struct(F.lit(0).alias("id"), F.lit("block").alias("M"), F.col("o_orderpriority").alias("priority"), assign.alias("x"), F.array(back).alias("children"))
    return H.flatten_ast(views.table(spark, d, "orders").select(F.col("o_orderkey").alias("tree"), F.to_json(tree).alias("json")))


@query("h2_parent_child_edges", sql(both(EDGES), "v5"))
def h2(spark, d):
    return H.parent_child_edges(views.trees(spark, d), both_ways=True)


@query("h3_subtree_size", sql("""SELECT tree, node_id, count(*) AS size FROM (SELECT tree, node_id FROM v5 UNION ALL SELECT tree, parent FROM v5 WHERE parent IS NOT NULL
    UNION ALL SELECT a.tree, b.parent FROM v5 a JOIN v5 b ON a.tree = b.tree AND a.parent = b.node_id WHERE b.parent IS NOT NULL) GROUP BY ALL""", "v5"))
def h3(spark, d):
    return H.subtree_size(views.trees(spark, d))


@query("h4_terminal_nodes", sql(LEAVES, "v5"))
def h4(spark, d):
    return H.terminal_nodes(views.trees(spark, d))


CHAIN = f"SELECT tree, node_id AS src, n AS dst FROM (SELECT tree, node_id, lead(node_id) OVER (PARTITION BY tree ORDER BY node_id) AS n FROM ({LEAVES})) WHERE n IS NOT NULL"


@query("h5_terminal_chain", sql(both(CHAIN), "v5"))
def h5(spark, d):
    return H.terminal_chain(views.trees(spark, d))


def mentions(spark, d):
    return views.table(spark, d, "events").select(F.col("user_id").alias("tree"), F.col("event_type").alias("variable"), "ts", F.col("event_id").alias("node_id"))


@query("h6_variable_usage_chain", f"SELECT tree, node_id AS src, n AS dst FROM (SELECT tree, node_id, lead(node_id) OVER (PARTITION BY tree, variable ORDER BY ts, node_id) AS n FROM ({MENTIONS})) WHERE n IS NOT NULL")
def h6(spark, d):
    return H.variable_usage_chain(mentions(spark, d))


@query("h7_root_to_arguments", sql("SELECT tree, 0 AS src, node_id AS dst FROM v5 WHERE argument", "v5"))
def h7(spark, d):
    return H.root_to_arguments(views.trees(spark, d))


@query("h8_master_edges", sql(both("SELECT tree, -1 AS src, node_id AS dst FROM v5"), "v5"))
def h8(spark, d):
    return H.master_edges(views.trees(spark, d))


@query("h9_variable_master_edges", "SELECT user_id AS tree, event_type AS master, event_id AS dst FROM events")
def h9(spark, d):
    return H.variable_master_edges(mentions(spark, d))


PACKED = "SELECT kind, tree, node_id, row_number() OVER (ORDER BY kind, tree, node_id) - 1 AS packed_id, row_number() OVER (PARTITION BY kind ORDER BY tree, node_id) - 1 AS in_group FROM (SELECT 0 AS kind, tree, node_id FROM v5 UNION ALL SELECT DISTINCT 1, tree, -1 FROM v5)"


def packed(spark, d):
    nodes = views.trees(spark, d)
    return nodes, H.pack_graph(nodes, nodes.select("tree", F.lit(-1).cast("long").alias("node_id")).distinct())


@query("h10_pack_graph", sql(PACKED, "v5"))
def h10(spark, d):
    return packed(spark, d)[1]


@query("h11_canonicalize_constants", "SELECT p_partkey, ['str', 'num', 'fnum', 'var'][p_partkey % 4 + 1] AS opcode, ['STRING', 'NUMBER', 'FLOAT', p_name][p_partkey % 4 + 1] AS payload FROM part")
def h11(spark, d):
    opcode = F.element_at(F.array(*map(F.lit, ("str", "num", "fnum", "var"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return H.canonicalize_constants(views.table(spark, d, "part").select("p_partkey", opcode.alias("opcode"), F.col("p_name").alias("payload")))


@query("h12_annotate_arguments", sql("SELECT tree, node_id, coalesce(named, false) AS argument FROM v5 LEFT JOIN (SELECT DISTINCT tree, name, true AS named FROM v5 WHERE argument) a USING (tree, name)", "v5"))
def h12(spark, d):
    nodes = views.trees(spark, d).withColumnRenamed("name", "variable")
    return H.annotate_arguments(nodes.drop("argument"), nodes.where("argument")).select("tree", "node_id", "argument")


@query("h13_check_tree", sql("SELECT tree, count(*) AS size, count(*) = max(id) + 1 AND count(DISTINCT id) = count(*) AS good, count(*) - count(DISTINCT id) AS duplicates FROM (SELECT tree, CASE WHEN tree % 5 = 0 AND node_id = 3 THEN 2 ELSE node_id END AS id FROM v5) GROUP BY tree", "v5"))
def h13(spark, d):
    broken = F.when((F.col("tree") % 5 == 0) & (F.col("node_id") == 3), 2).otherwise(F.col("node_id"))
    return H.check_tree(views.trees(spark, d).withColumn("node_id", broken))


@query("h14_opcode_counts", "SELECT n_name AS name, CASE WHEN l_suppkey % 30 >= 12 THEN 'statement' ELSE 'expression' END AS kind, count(*) AS n FROM lineitem LEFT JOIN nation ON n_nationkey = l_suppkey % 30 GROUP BY ALL")
def h14(spark, d):
    nodes = views.table(spark, d, "lineitem").select((F.col("l_suppkey") % 30).alias("opcode"))
    names = views.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("opcode"), F.col("n_name").alias("name"))
    return H.opcode_counts(nodes, names, 12)


@query("h15_tree_fingerprint", sql("SELECT min(tree) AS first, count(*) AS trees FROM (SELECT tree, string_agg(concat(node_id, ':', coalesce(parent, -1), ':', coalesce(name, '')), ';' ORDER BY node_id) AS s FROM v5 GROUP BY tree) GROUP BY s", "v5"))
def h15(spark, d):
    return H.tree_fingerprint(views.trees(spark, d), ["name"]).groupBy("fingerprint").agg(F.min("tree").alias("first"), F.count("*").alias("trees")).drop("fingerprint")


@query("h16_function_identifiers", sql("SELECT tree, CASE WHEN parent IS NULL THEN concat('fn', tree) ELSE name END AS identifier FROM v5 WHERE parent IS NULL OR (node_type = 'line' AND argument)", "v5"))
def h16(spark, d):
    nodes = views.trees(spark, d)
    named = nodes.withColumns({"name": F.when(F.col("parent").isNull(), F.concat(F.lit("fn"), "tree")).otherwise(F.col("name")), "node_type": F.when((F.col("node_type") == "line") & F.col("argument"), "obj").otherwise(F.col("node_type"))})
    return H.function_identifiers(named)


@query("h17_node_features", sql(f"""SELECT tree, node_id, CAST(CASE node_type WHEN 'customer' THEN 0 WHEN 'line' THEN 1 ELSE 2 END AS BIGINT) AS type_id, CASE WHEN name IS NULL THEN 0 ELSE coalesce(v.id, 3) END AS name_id
    FROM v5 LEFT JOIN ({vocab_sql("SELECT src_type AS word, count(*) AS freq FROM v2 GROUP BY 1", 9, 1)}) v ON v.word = name""", "v5"))
def h17(spark, d):
    nodes = views.trees(spark, d)
    words = V.vocab_from_counts(views.variables(spark, d).groupBy(F.col("src_type").alias("word")).agg(F.count("*").alias("freq")), 9, 1)
    kinds = V.build_grammar(nodes, words.where("false")).where("kind = 'node'")
    return H.node_features(nodes, kinds, words)


@query("h18_restore_by_tree", sql(f"SELECT tree, string_agg(CAST(packed_id AS VARCHAR), ',' ORDER BY packed_id) AS nodes, coalesce(string_agg(CASE WHEN leaf THEN CAST(packed_id AS VARCHAR) END, ',' ORDER BY packed_id), '') AS terminals FROM (SELECT p.*, (tree, node_id) IN ({LEAVES.replace('tree, node_id FROM v5 ANTI', '(tree, node_id) FROM v5 ANTI', 1)}) AS leaf FROM ({PACKED}) p WHERE kind = 0) GROUP BY tree", "v5"))
def h18(spark, d):
    nodes, all_ = packed(spark, d)
    out = H.restore_by_tree(all_.where("kind = 0"), H.terminal_nodes(nodes))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("tree", text("nodes").alias("nodes"), text("terminals").alias("terminals"))
