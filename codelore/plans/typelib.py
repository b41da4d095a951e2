"""Queries over types, layouts and the type library."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelore.functions import ctypes as C
from codelore.operators import typelib as L
from codelore.operators.lineage import cut
from codelore.plans import views
from codelore.plans.register import query
from codelore.plans.views import sql

def x():
    return F.col("type")


def structs(spark, d, **more):
    return views.structs(views.variables(spark, d), **more)


def joined(c, mark=","):
    return F.array_join(F.transform(c, lambda b: b.cast("string")), mark)


#: One type of each kind in its encoding, keyed by the part that it is put beside.
KINDS = [
    '{"T":1,"n":"int","s":4}', '{"T":2,"n":4,"s":4,"t":"int"}', '{"T":2,"n":0,"s":1,"t":"char"}', '{"T":3,"t":"char"}',
    '{"T":6,"n":"s","l":[{"T":4,"n":"a","t":"int","s":4},{"T":4,"n":"b","t":"char","s":1},{"T":5,"s":3},{"T":4,"n":"c","t":"long","s":8},{"T":4,"n":"d","t":"long","s":8}]}',
    '{"T":7,"n":"u","m":[{"T":4,"n":"i","t":"int","s":4},{"T":4,"n":"c","t":"char","s":1}],"p":{"T":5,"s":4}}', '{"T":8}', '{"T":9,"n":"int (*)(void)"}', '{"T":10}',
]
KIND_STRINGS = ["int", "int[4]", "char[]", "char *", "struct s { int a; char b; PADDING (3); long c; long d; }", "union u { int i; char c; PADDING (4); }", "void", "int (*)(void)", "disappear"]
KIND_SIZES = [4, 16, 0, 8, 24, 8, 0, 8, 0]
_cases = lambda values: "CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(values)) + " END"


@query("d1_decode_type", f"SELECT p_partkey, {_cases(KIND_STRINGS)} AS type_str, CAST({_cases(KIND_SIZES)} AS BIGINT) AS size, p_partkey % 9 IN (4, 5) AS has_padding FROM part")
def d1(spark, d):
    json = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % 9 + 1).cast("int"))
    return views.table(spark, d, "part").select("p_partkey", C.decode_type(json).alias("type")).select("p_partkey", C.type_string(x()).alias("type_str"), C.type_size(x()).alias("size"), C.has_padding(x()).alias("has_padding"))


NAME = "concat('struct s', func, ' { ', body, '; }')"


@query("d2_type_string", sql(f"SELECT func, {NAME} AS type_str FROM shown", "shown"))
def d2(spark, d):
    return structs(spark, d).select("func", C.type_string(x()).alias("type_str"))


@query("d3_type_size", sql("SELECT func, size FROM shown", "shown"))
def d3(spark, d):
    return structs(spark, d).select("func", C.type_size(x()).alias("size"))


@query("d4_accessible_offsets", sql("SELECT func, array_to_string(accessible, ',') AS bytes FROM layouts", "layouts"))
def d4(spark, d):
    return structs(spark, d).select("func", joined(C.accessible_offsets(x())).alias("bytes"))


@query("d5_inaccessible_offsets", sql("SELECT func, array_to_string(inaccessible, ',') AS bytes FROM layouts", "layouts"))
def d5(spark, d):
    return structs(spark, d).select("func", joined(C.inaccessible_offsets(x())).alias("bytes"))


@query("d6_start_offsets", sql("SELECT func, array_to_string(starts, ',') AS starts FROM layouts", "layouts"))
def d6(spark, d):
    return structs(spark, d).select("func", joined(C.start_offsets(x())).alias("starts"))


@query("d7_tokenize_type", sql("SELECT func, concat('<struct> | s', func, ' | ', tokens, ' | <eot>') AS tokens FROM shown", "shown"))
def d7(spark, d):
    return structs(spark, d).select("func", F.array_join(C.tokenize_type(x()), " | ").alias("tokens"))


@query("d8_detokenize_types", sql(f"SELECT func, {NAME} AS type_str FROM shown", "shown"))
def d8(spark, d):
    return structs(spark, d).select("func", F.array_join(C.detokenize_types(C.tokenize_type(x())), " & ").alias("type_str"))


@query("d9_type_key", sql("""SELECT min(func) AS first, count(*) AS n FROM (SELECT func, string_agg(CASE WHEN padding THEN concat('P', size) ELSE concat(src_type, ' ', old_name) END, ';' ORDER BY pos) AS k FROM v2 GROUP BY func) GROUP BY k""", "v2"))
def d9(spark, d):
    return structs(spark, d, name="s").groupBy(C.type_key(x()).alias("key")).agg(F.min("func").alias("first"), F.count("*").alias("n")).drop("key")


@query("d10_replaceable_with", sql("""SELECT a.func, count(*) AS n, min(b.func) AS first FROM layouts a JOIN layouts b ON a.size = b.size AND a.accessible = b.accessible AND a.inaccessible = b.inaccessible
    AND len(list_filter(a.starts, lambda x: NOT list_contains(b.starts, x))) = 0 GROUP BY a.func""", "layouts"))
def d10(spark, d):
    rows = L.layouts(structs(spark, d).withColumn("name", F.col("func")))
    return L.replaceable_counts(rows, rows).withColumnRenamed("name", "func")


def library(spark, d):
    return L.build_typelib(views.table(spark, d, "part").select(F.col("p_size").alias("size"), F.col("p_type").alias("type_str")))


LIB = "SELECT p_size AS size, p_type AS type_str, count(*) AS freq FROM part GROUP BY ALL"


@query("d11_build_typelib", LIB)
def d11(spark, d):
    return library(spark, d)


@query("d12_merge_typelibs", LIB)
def d12(spark, d):
    p = views.table(spark, d, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_type").alias("type_str"))
    return L.merge_typelibs(*(L.build_typelib(p.where(F.col("p_partkey") % 2 == k)) for k in (0, 1)))


@query("d13_prune_typelib", f"SELECT * FROM ({LIB}) WHERE freq >= 5")
def d13(spark, d):
    return L.prune_typelib(library(spark, d))


@query("d14_rank_typelib", f"SELECT *, row_number() OVER (PARTITION BY size ORDER BY freq DESC, type_str) AS rank FROM ({LIB})")
def d14(spark, d):
    return L.rank_typelib(library(spark, d))


@query("d15_size_frequency", "SELECT p_size AS size, count(*) AS freq FROM part GROUP BY ALL")
def d15(spark, d):
    return L.size_frequency(library(spark, d))


@query("d16_type_frequency", f"SELECT p_partkey, p.size, p.type_str, freq FROM (SELECT p_partkey, p_size AS size, CASE WHEN p_partkey % 3 = 0 THEN 'nowhere' ELSE p_type END AS type_str FROM part) p LEFT JOIN ({LIB}) l USING (size, type_str)")
def d16(spark, d):
    asked = views.table(spark, d, "part").select("p_partkey", F.col("p_size").alias("size"), F.when(F.col("p_partkey") % 3 == 0, "nowhere").otherwise(F.col("p_type")).alias("type_str"))
    return L.type_frequency(asked, library(spark, d)).select("p_partkey", "size", "type_str", "freq")


@query("d17_fix_bits", sql("""SELECT size, count(*) AS freq, min(concat('struct s { ', body, '; }')) AS type_str FROM shown
    JOIN (SELECT func, string_agg(CASE WHEN padding THEN concat('P', size) ELSE concat(src_type, ' ', old_name) END, ';' ORDER BY pos) AS k, bool_or(NOT padding) AS fields FROM v2 GROUP BY func) USING (func)
    WHERE NOT (fields AND func % 5 = 0) GROUP BY size, k""", "shown"))
def d17(spark, d):
    bits = structs(spark, d, name="s", field_size=F.col("size") * 8 + F.when(F.col("func") % 5 == 0, 1).otherwise(0))
    return L.fix_bits(bits.select("type", F.lit(1).cast("long").alias("freq"))).drop("key")


@query("d18_layout_index", sql("SELECT array_to_string(accessible, ',') AS accessible, array_to_string(starts, ',') AS starts, count(*) AS names, min(func) AS first FROM layouts WHERE size <= 1024 GROUP BY ALL", "layouts"))
def d18(spark, d):
    types = structs(spark, d).withColumn("name", F.col("func"))
    index = L.layout_index(types)
    return index.join(counted(types, index), "layout_id").select(joined("accessible").alias("accessible"), joined("starts").alias("starts"), "names", "first")


def shapes(spark, d):
    """Distinct layouts of the functions' structs, a struct a function, with the number of functions and the first of them."""
    rows = L.layouts(structs(spark, d).withColumn("name", F.col("func")))
    return cut(rows.groupBy("size", "accessible", "starts").agg(F.count("*").alias("names"), F.min("name").alias("first")))


def counted(types, index):
    """Number and first of the names of each layout."""
    return L.layout_names(types, index).groupBy("layout_id").agg(F.count("*").alias("names"), F.min("name").alias("first"))


def stack_rows(spark, d):
    v = views.variables(spark, d).where(F.col("loc").startswith("s"))
    return L.stack_layout(v.select("func", (8 * F.col("pos")).alias("offset"), "size", C._range(F.lit(0).cast("long"), F.col("size")).alias("accessible"), F.array(F.lit(0).cast("long")).alias("starts")))


@query("d19_next_replacements", sql("""SELECT p.func AS id, cut, CAST(coalesce(names, 0) AS BIGINT) AS names, first, array_to_string(rest, ',') AS rest FROM (
    SELECT func, cut, list_transform(list_filter(accessible, lambda b: b < cut_at), lambda b: b - cut_at + cut) AS a, list_transform(list_filter(starts, lambda b: b < cut_at), lambda b: b - cut_at + cut) AS s,
           list_filter(accessible, lambda b: b >= cut_at) AS rest, list_filter(starts, lambda b: b >= cut_at) AS rest_starts
    FROM (SELECT st.*, z.size AS cut, accessible[1] + z.size AS cut_at FROM stack st JOIN (SELECT DISTINCT size FROM layouts) z ON z.size <= accessible[-1] - accessible[1] + 1 WHERE accessible[1] = starts[1])) p
    LEFT JOIN (SELECT accessible, starts, count(*) AS names, min(func) AS first FROM layouts WHERE size <= 1024 GROUP BY ALL) i ON i.accessible = p.a AND i.starts = p.s
    WHERE (len(rest) = 0 AND len(rest_starts) = 0) OR (len(rest_starts) > 0 AND rest[1] = rest_starts[1])""", "layouts", "stack"))
def d19(spark, d):
    all_ = shapes(spark, d)
    # Number and first of the names go with the layouts that are looked up, not with every cut of every function.
    index = L.index_of(all_, 1024, F.sum("names").alias("names"), F.min("first").alias("first"))
    out = L.next_replacements(stack_rows(spark, d).withColumnRenamed("func", "id"), index, L.sizes(all_))
    return out.select("id", "cut", F.coalesce("names", F.lit(0)).cast("long").alias("names"), "first", joined("rest_accessible").alias("rest"))


@query("d20_valid_layout", sql("""SELECT st.func AS id, st.accessible[1] = st.starts[1] AND EXISTS (SELECT 1 FROM (SELECT DISTINCT size FROM layouts) z JOIN layouts i ON i.size <= 1024
        WHERE z.size <= st.accessible[-1] - st.accessible[1] + 1 AND i.accessible = list_transform(list_filter(st.accessible, lambda b: b < st.accessible[1] + z.size), lambda b: b - st.accessible[1])
        AND i.starts = list_transform(list_filter(st.starts, lambda b: b < st.accessible[1] + z.size), lambda b: b - st.accessible[1])
        AND coalesce(list_filter(st.accessible, lambda b: b >= st.accessible[1] + z.size)[1], -1) = coalesce(list_filter(st.starts, lambda b: b >= st.accessible[1] + z.size)[1], -1)
        AND i.func = m.func) AS valid
    FROM stack st, (SELECT min(func) AS func FROM layouts WHERE size = len(accessible) AND len(starts) = 1 AND size = 1) m""", "layouts", "stack"))
def d20(spark, d):
    all_ = shapes(spark, d)
    one = all_.where((F.col("size") == F.size("accessible")) & (F.size("starts") == 1) & (F.col("size") == 1)).agg(F.min("first").alias("name"))
    index = L.index_of(all_)
    asked = structs(spark, d).withColumn("name", F.col("func")).join(F.broadcast(one), "name", "left_semi")
    stack = stack_rows(spark, d).select(F.col("func").alias("id"), "accessible", "starts")
    wanted = stack.select("id").crossJoin(F.broadcast(one)).select("id", F.array("name").alias("names"))
    return L.valid_layout(stack, wanted, index, L.layout_names(asked, index), all_.select("size"))


@query("d21_stack_layout", sql("SELECT func, array_to_string(accessible, ',') AS accessible, array_to_string(starts, ',') AS starts, meets FROM stack", "stack"))
def d21(spark, d):
    return stack_rows(spark, d).select("func", joined("accessible").alias("accessible"), joined("starts").alias("starts"), "meets")


@query("d22_sequence_offsets", sql("""SELECT func // 10 AS id, array_to_string(flatten(list(list_transform(accessible, lambda b: b + moved) ORDER BY func)), ',') AS accessible,
    array_to_string(flatten(list(list_transform(starts, lambda b: b + moved) ORDER BY func)), ',') AS starts FROM (
    SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY func // 10 ORDER BY func ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS moved FROM layouts) GROUP BY 1""", "layouts"))
def d22(spark, d):
    rows = L.layouts(structs(spark, d).withColumn("name", F.col("func")))
    out = L.sequence_offsets(rows.select(F.floor(F.col("name") / 10).alias("id"), F.col("name").alias("pos"), "size", "accessible", "starts"))
    return out.select("id", joined("accessible").alias("accessible"), joined("starts").alias("starts"))


@query("d23_type_closure", """WITH RECURSIVE m AS (SELECT count(*) AS m FROM part), c AS (SELECT p_partkey AS name FROM part WHERE p_size = 4
    UNION SELECT p_partkey * 7 % m + 1 FROM c JOIN part ON p_partkey = name, m WHERE p_size % 2 = 0) SELECT name FROM c""")
def d23(spark, d):
    p = views.table(spark, d, "part")
    total = p.agg(F.count("*").alias("m"))
    refs = p.where("p_size % 2 = 0").crossJoin(F.broadcast(total)).select(F.col("p_partkey").alias("name"), (F.col("p_partkey") * 7 % F.col("m") + 1).alias("target"))
    return L.type_closure(p.where("p_size = 4").select(F.col("p_partkey").alias("name")), refs)


def members(spark, d):
    v = views.variables(spark, d)
    placed = structs(spark, d).select("func", C.placed(x()["l"]).alias("p"), C.type_size(x()).alias("total"))
    return v, placed.select(F.col("func").alias("id"), "total", F.explode("p").alias("p")).where(F.col("p.tag") == C.FIELD).select("id", F.col("p.at").alias("offset"), F.col("p.s").alias("size"), "total")


@query("d24_insert_padding", sql("""WITH m AS (SELECT func AS id, start AS "offset", size FROM v3 WHERE NOT padding), t AS (SELECT func AS id, size AS total FROM shown)
    SELECT id, "offset", size, false AS padding FROM m
    UNION ALL SELECT id, until, "offset" - until, true FROM (SELECT *, coalesce(lag("offset" + size) OVER (PARTITION BY id ORDER BY "offset"), 0) AS until FROM m) WHERE "offset" > until
    UNION ALL SELECT id, e, total - e, true FROM (SELECT id, max("offset" + size) AS e FROM m GROUP BY id) JOIN t USING (id) WHERE e < total""", "v3", "shown").replace(" WITH m AS", ", m AS", 1))
def d24(spark, d):
    return L.insert_padding(members(spark, d)[1])


@query("d25_union_padding", sql("SELECT func AS id, CAST(sum(size) - max(size) AS BIGINT) AS padding FROM v2 GROUP BY func", "v2"))
def d25(spark, d):
    v = views.variables(spark, d)
    total = v.groupBy("func").agg(F.sum("size").alias("total"))
    return L.union_padding(v.join(total, "func").select(F.col("func").alias("id"), "size", "total"))


@query("d26_types_of_size", f"SELECT size, type_str, freq FROM ({LIB}) WHERE size = 10 UNION ALL SELECT DISTINCT p_size, NULL, NULL FROM part")
def d26(spark, d):
    lib = library(spark, d)
    return L.types_of_size(lib, 10).unionByName(L.sizes(lib), allowMissingColumns=True)


@query("d27_has_padding", sql("SELECT func, bool_or(padding) AS has_padding FROM v2 GROUP BY func", "v2"))
def d27(spark, d):
    return structs(spark, d).select("func", C.has_padding(x()).alias("has_padding"))


@query("d28_type_pieces", sql("SELECT DISTINCT concat('struct s { ', body, '; }') AS type_str, concat('<struct> | s | ', tokens) AS pieces FROM shown UNION ALL SELECT '<unk>', '<unk>'", "shown"))
def d28(spark, d):
    return L.type_pieces(structs(spark, d, name="s")).select("type_str", F.array_join("pieces", " | ").alias("pieces"))
