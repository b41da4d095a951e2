"""The driver's tables read as a corpus: functions, variables, structs, stack frames, trees, mentions and scored predictions.

Each view is a DataFrame here and a common table expression of the same name for the SQL that checks it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelore.operators import baselines, evaluate, splits
from codelore.operators.lineage import cut, dealt

SEED = "1234"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: documents as functions of 20 binaries."""
    d = table(spark, sf_dir, "documents")
    name = F.when(F.col("n_chars") % 5 == 0, F.concat(F.lit("u"), F.col("doc_id"))).otherwise(F.col("lang"))
    return d.select(F.col("source").alias("bin"), name.alias("name"), F.col("doc_id").alias("line_no"), F.col("text").alias("body"))


def _binary() -> Column:
    """The binary of an order; 199 there are at most."""
    return F.concat(F.lit("b"), F.col("o_custkey") % 100)


def _target() -> Column:
    """The target type that a part stands for."""
    struct = F.when((F.col("p_size") % 3 == 0) & F.col("p_type").isin("LARGE", "SMALL", "PROMO"), F.concat(F.lit("struct "), "p_type"))
    return struct.when(F.col("p_size") % 7 == 0, F.concat(F.lit("struct "), "p_brand")).otherwise(F.col("p_brand"))


def variables(spark: SparkSession, sf_dir: str, funcs: DataFrame | None = None, many: int | None = None) -> DataFrame:
    """V2: order lines as variables with a source and a target, orders as functions, customers as binaries.

    The lines of a function lie in one task, of a bounded number of rows, for all that is grouped by function after it.
    With ``funcs``, the functions of these keys alone, about ``many`` rows; other lines are left out before they meet their parts.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate", "l_returnflag", "l_linestatus", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    if many is None:
        many = lines.count()
    if funcs is not None:
        lines = lines.join(funcs, F.col("l_orderkey") == F.col("func"), "left_semi")
    named = dealt(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")), many, "l_orderkey")
    rows = named.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = rows.withColumn("pos", F.row_number().over(order).cast("long"))
    old = F.concat(F.lit("v"), F.col("pos"))
    return rows.select(
        _binary().alias("bin"),
        F.col("l_orderkey").alias("func"),
        F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("f"), F.col("l_orderkey") % 50)).otherwise(F.concat(F.lit("g"), F.col("l_orderkey"))).alias("func_name"),
        "pos",
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("r"), F.col("pos"))).otherwise(F.concat(F.lit("s"), 8 * F.col("pos"))).alias("loc"),
        old.alias("old_name"),
        F.when(F.col("p_size") % 9 == 0, old).otherwise(F.element_at(F.split("p_name", " "), -1)).alias("new_name"),
        F.col("p_type").alias("src_type"),
        _target().alias("tgt_type"),
        (F.col("l_linestatus") == "F").alias("user"),
        (1 + F.col("l_quantity").cast("long") % 8).alias("size"),
        (F.col("l_returnflag") == "N").alias("padding"),
    )


def bodies(variables_: DataFrame) -> DataFrame:
    """A row a function of V2: its source types in order are its body."""
    types = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "src_type"))), lambda x: x["src_type"]), " ")
    return variables_.groupBy("bin", "func", "func_name").agg(types.alias("body"))


def split(variables_: DataFrame) -> DataFrame:
    return splits.split_by_binary(variables_.select("bin").distinct(), SEED)


def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many variables of V2 a binary has of a source and a target type; only keys of the lines are sent."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    many = lines.count()
    owned = dealt(lines, many, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(_binary().alias("bin"), "l_partkey")
    rows = dealt(owned, many, "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("bin", F.col("p_type").alias("src_type"), _target().alias("tgt_type")).agg(F.count("*").alias("n"))


def train_counts_and_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Numbers of train variables by source and target type, and the test variables.

    Variables are counted once, for the split and for train; test reads the functions that a test binary has, and reads them whole,
    so that their positions stay.  The split has a row a binary, 199 at most, and is broadcast.
    """
    counts = cut(type_counts(spark, sf_dir))
    parts = F.broadcast(split(counts))
    known = {s: parts.where(F.col("split") == s).select("bin") for s in ("train", "test")}
    many = counts.join(known["test"], "bin", "left_semi").agg(F.sum("n")).first()[0] or 0
    orders = table(spark, sf_dir, "orders").select(_binary().alias("bin"), F.col("o_orderkey").alias("func"))
    funcs = orders.join(known["test"], "bin", "left_semi").select("func")
    train = counts.join(known["train"], "bin", "left_semi").groupBy("src_type", "tgt_type").agg(F.sum("n").alias("n"))
    return train, variables(spark, sf_dir, funcs, many).join(known["test"], "bin", "left_semi")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: test variables with leakage flags and predictions."""
    v = variables(spark, sf_dir)
    parts = split(v)
    train, test = (v.join(parts.where(F.col("split") == s).select("bin"), "bin", "left_semi") for s in ("train", "test"))
    flags = splits.annotate_split(bodies(v).join(parts, "bin")).where("split = 'test'").select("bin", "func", "name_in_train", "body_in_train")
    learnt = baselines.most_common_for_source(train, test)
    name = F.when(F.col("pos") % 3 == 0, F.col("old_name")).otherwise(F.col("new_name"))
    preds = learnt.where(F.col("func") % 11 != 0).select("bin", "func", "pos", "pred_type", name.alias("pred_name"))
    return evaluate.align(preds, test).join(flags, ["bin", "func"])


SQL = {
    "v1": "SELECT source AS bin, CASE WHEN n_chars % 5 = 0 THEN concat('u', doc_id) ELSE lang END AS name, doc_id AS line_no, text AS body FROM documents",
    "v2": """SELECT concat('b', o_custkey % 100) AS bin, l_orderkey AS func,
        CASE WHEN o_custkey % 2 = 0 THEN concat('f', l_orderkey % 50) ELSE concat('g', l_orderkey) END AS func_name, pos,
        CASE WHEN l_returnflag = 'R' THEN concat('r', pos) ELSE concat('s', 8 * pos) END AS loc, concat('v', pos) AS old_name,
        CASE WHEN p_size % 9 = 0 THEN concat('v', pos) ELSE string_split(p_name, ' ')[-1] END AS new_name, p_type AS src_type,
        CASE WHEN p_size % 3 = 0 AND p_type IN ('LARGE', 'SMALL', 'PROMO') THEN concat('struct ', p_type)
             WHEN p_size % 7 = 0 THEN concat('struct ', p_brand) ELSE p_brand END AS tgt_type,
        l_linestatus = 'F' AS "user", 1 + CAST(trunc(l_quantity) AS BIGINT) % 8 AS size, l_returnflag = 'N' AS padding
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pos
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""",
    "bodies": "SELECT bin, func, func_name, string_agg(src_type, ' ' ORDER BY pos) AS body FROM v2 GROUP BY bin, func, func_name",
    "bins": "SELECT bin, row_number() OVER (ORDER BY sha256(concat('1234:', bin)), bin) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT bin FROM v2)",
    "parts": "SELECT bin, CASE WHEN rn <= n // 10 THEN 'test' WHEN rn <= 2 * (n // 10) THEN 'dev' ELSE 'train' END AS split FROM bins",
    "defined": "SELECT bin, func_name, arg_max(body, func) AS body FROM bodies JOIN parts USING (bin) WHERE split = 'train' GROUP BY bin, func_name",
    "flags": """SELECT b.bin, b.func, b.func_name, p.split, b.func_name IN (SELECT func_name FROM defined) AS name_in_train,
        EXISTS (SELECT 1 FROM defined d WHERE d.func_name = b.func_name AND d.body = b.body) AS body_in_train
        FROM bodies b JOIN parts p USING (bin)""",
    "train": "SELECT v2.* FROM v2 JOIN parts USING (bin) WHERE split = 'train'",
    "test": "SELECT v2.* FROM v2 JOIN parts USING (bin) WHERE split = 'test'",
    "j3": """SELECT src_type, tgt_type FROM (SELECT src_type, tgt_type, row_number() OVER (PARTITION BY src_type ORDER BY count(*) DESC, tgt_type) AS rn
        FROM train GROUP BY src_type, tgt_type) WHERE rn = 1""",
    "v7": """SELECT t.bin, t.func, t.func_name, t.pos, t.old_name, t.new_name, t.src_type, t.tgt_type, t.size,
        CASE WHEN t.func % 11 = 0 THEN '' ELSE coalesce(j.tgt_type, t.src_type) END AS pred_type,
        CASE WHEN t.func % 11 = 0 THEN '' WHEN t.pos % 3 = 0 THEN t.old_name ELSE t.new_name END AS pred_name,
        f.name_in_train, f.body_in_train
        FROM test t LEFT JOIN j3 j USING (src_type) JOIN flags f ON f.bin = t.bin AND f.func = t.func""",
}
_NEEDS = {"bodies": ["v2"], "bins": ["v2"], "parts": ["bins"], "defined": ["bodies", "parts"], "flags": ["defined"], "train": ["parts"], "test": ["parts"], "j3": ["train"], "v7": ["test", "j3", "flags"]}


def sql(query: str, *names: str) -> str:
    """The query after the views that it names and the views that those need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + " " + query if order else query


def structs(variables_: DataFrame, name=None, field_size=None) -> DataFrame:
    """V3: one struct a function, its variables the fields; ``func, name, type``."""
    from codelore.functions import ctypes as C

    size = F.col("size") if field_size is None else field_size
    part = F.struct(
        "pos",
        F.when(F.col("padding"), C.PADDING).otherwise(C.FIELD).alias("tag"),
        F.when(~F.col("padding"), F.col("old_name")).alias("n"),
        F.when(~F.col("padding"), F.col("src_type")).alias("t"),
        F.when(F.col("padding"), F.col("size")).otherwise(size).alias("s"),
    )
    label = F.concat(F.lit("s"), "func") if name is None else F.lit(name)
    rows = variables_.groupBy("func").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    layout = F.transform("parts", lambda p: F.struct(p["tag"].alias("tag"), p["n"].alias("n"), p["t"].alias("t"), p["s"].cast("long").alias("s")))
    none = F.lit(None)
    kind = F.struct(F.lit(C.STRUCT).alias("tag"), label.alias("n"), none.cast("long").alias("s"), none.cast("string").alias("t"), layout.alias("l"), none.cast(f"array<{C.PART}>").alias("m"), none.cast(C.PART).alias("p"))
    return rows.select("func", label.alias("name"), kind.alias("type"))


SQL["v3"] = "SELECT func, pos, size, padding, old_name, src_type, CAST(coalesce(sum(size) OVER (PARTITION BY func ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM v2"
SQL["shown"] = "SELECT func, string_agg(CASE WHEN padding THEN concat('PADDING (', size, ')') ELSE concat(src_type, ' ', old_name) END, '; ' ORDER BY pos) AS body, string_agg(CASE WHEN padding THEN concat('PADDING (', size, ')') ELSE concat(src_type, ' ', old_name) END, ' | ' ORDER BY pos) AS tokens, CAST(sum(size) AS BIGINT) AS size FROM v2 GROUP BY func"
SQL["bytes"] = "SELECT func, padding, unnest(range(start, start + size)) AS b FROM v3"
SQL["layouts"] = """SELECT s.func, s.size, coalesce(a.x, []) AS accessible, coalesce(i.x, []) AS inaccessible, coalesce(t.x, []) AS starts FROM shown s
    LEFT JOIN (SELECT func, list(b ORDER BY b) AS x FROM bytes WHERE NOT padding GROUP BY func) a USING (func)
    LEFT JOIN (SELECT func, list(b ORDER BY b) AS x FROM bytes WHERE padding GROUP BY func) i USING (func)
    LEFT JOIN (SELECT func, list(start ORDER BY start) AS x FROM v3 WHERE NOT padding GROUP BY func) t USING (func)"""
SQL["stack"] = """SELECT func, list_sort(list_distinct(a)) AS accessible, list_sort(list_distinct(s)) AS starts, len(a) <> len(list_distinct(a)) OR len(s) <> len(list_distinct(s)) AS meets FROM (
    SELECT func, flatten(list(range(8 * pos - size, 8 * pos))) AS a, list(8 * pos - size) AS s FROM v2 WHERE starts_with(loc, 's') GROUP BY func)"""
_NEEDS |= {"v3": ["v2"], "shown": ["v2"], "bytes": ["v3"], "layouts": ["shown", "bytes"], "stack": ["v2"]}


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: a customer's orders and their lines as a tree; customers, not regions, so that a tree stays of bounded size.

    Nodes are numbered in preorder; a line's name is its part's brand, an argument where its status is F.
    """
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = variables(spark, sf_dir).select(F.col("func").alias("o_orderkey"), "pos", "src_type", F.col("user").alias("argument"))
    none = F.lit(None).cast("long")
    top = customers.select(F.col("c_custkey").alias("tree"), none.alias("o"), none.alias("p"), F.lit("customer").alias("node_type"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("argument"))
    middle = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_custkey").alias("tree"), F.col("o_orderkey").alias("o"), none.alias("p"), F.lit("order").alias("node_type"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("argument"))
    leaves = lines.join(orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi"), "o_orderkey").select(F.col("o_custkey").alias("tree"), F.col("o_orderkey").alias("o"), F.col("pos").alias("p"), F.lit("line").alias("node_type"), F.col("src_type").alias("name"), "argument")
    many = sum(table(spark, sf_dir, t).count() for t in ("customer", "orders", "lineitem"))
    rows = dealt(top.unionByName(middle).unionByName(leaves), many, "tree")
    order = Window.partitionBy("tree").orderBy(F.asc_nulls_first("o"), F.asc_nulls_first("p"))
    rows = rows.withColumn("node_id", (F.row_number().over(order) - 1).cast("long"))
    above = F.max(F.when(F.col("p").isNull() & F.col("o").isNotNull(), F.col("node_id"))).over(Window.partitionBy("tree", "o"))
    parent = F.when(F.col("o").isNull(), none).when(F.col("p").isNull(), F.lit(0).cast("long")).otherwise(above)
    return rows.select("tree", "node_id", parent.alias("parent"), "node_type", "name", "argument")


SQL["v5"] = """SELECT tree, node_id, CASE WHEN o IS NULL THEN NULL WHEN p IS NULL THEN 0 ELSE max(CASE WHEN p IS NULL AND o IS NOT NULL THEN node_id END) OVER (PARTITION BY tree, o) END AS parent, node_type, name, argument FROM (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY o NULLS FIRST, p NULLS FIRST) - 1 AS node_id FROM (
    SELECT c_custkey AS tree, CAST(NULL AS BIGINT) AS o, CAST(NULL AS BIGINT) AS p, 'customer' AS node_type, CAST(NULL AS VARCHAR) AS name, false AS argument FROM customer
    UNION ALL SELECT o_custkey, o_orderkey, NULL, 'order', NULL, false FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT o_custkey, func, pos, 'line', src_type, "user" FROM v2 JOIN orders ON o_orderkey = func WHERE o_custkey IN (SELECT c_custkey FROM customer)))"""
_NEEDS["v5"] = ["v2"]
