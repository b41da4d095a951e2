"""Queries over text functions; arrays leave as joined strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelore.functions import text as T
from codelore.plans import views
from codelore.plans.register import query

TOKENS = T.TOKENS.replace("'", "''")
DUCK_TOKENS = f"regexp_extract_all(s, '({TOKENS})', 1, 's')"
KEPT = f"list_filter({DUCK_TOKENS}, lambda x: NOT (starts_with(x, '//') OR starts_with(x, '/*') OR x = '::'))"
NAMED = """list_transform(k, lambda x: CASE WHEN regexp_matches(x, '^["'']', 's') AND length(x) > 1 THEN 'String' WHEN regexp_matches(x, '^\\.?[0-9]') THEN 'Number' ELSE x END)"""
MERGED = "list_filter(n, lambda x, i: NOT (x = 'String' AND i > 1 AND n[i - 1] = 'String'))"


def tokens_sql(source: str) -> str:
    """The tokens ``t`` of (id, s)."""
    return f"SELECT id, {MERGED} AS t FROM (SELECT id, {NAMED} AS n FROM (SELECT id, {KEPT} AS k FROM ({source})))"


def fixture(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


CODE = [
    (1, "int x; // note\ny = 1;"), (2, "a /* b */ c"), (3, "@@VAR_0@@v4@@i = 0LL;"), (4, 'a->b >>= 0x1F; s = "x\\n" "y";'), (5, "::g = @@VAR_1@@a1@@p;"),
    (6, 'f(@@VAR_2@@a1@@dst, "unclosed'), (7, ""), (8, "x = .5e3 + 'c';\n z = VAR_3(VAR_4, VAR_4);\n"),
]


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else "NULL" if v is None else str(v) for v in r) + ")" for r in rows) + ")"


DOCS = "SELECT doc_id AS id, text AS s FROM documents"
COMMENTED = "replace(text, chr(10), '  // c' || chr(10))"


@query("b1_canonicalize_code", f"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace({COMMENTED}, '//.*?\\n|/\\*.*?\\*/', chr(10), 'gs'), '\\s+(\\\\n)', '\\1', 'g'), '\\s+$', ''), '@@\\w+@@(\\w+)@@\\w+', '\\1', 'g')) AS digest FROM documents""")
def b1(spark, d):
    docs = views.table(spark, d, "documents")
    return docs.select("doc_id", F.sha2(T.canonicalize_code(F.replace("text", F.lit("\n"), F.lit("  // c\n"))), 256).alias("digest"))


@query("b2_tokenize_code", f"SELECT id AS doc_id, CAST(len(t) AS BIGINT) AS n_tokens, sha256(array_to_string(t, ' ')) AS digest FROM ({tokens_sql(DOCS)})")
def b2(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", T.tokenize_code(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


def code_lines(spark, d):
    """Parts' names as assignments with placeholders, so that each row has all three names."""
    p = views.table(spark, d, "part")
    return p.select("p_partkey", F.concat(F.lit("::g = @@VAR_"), F.col("p_partkey") % 9, F.lit("@@v"), F.col("p_size"), F.lit("@@"), F.translate("p_name", " ", "_"), F.lit(" + 0x1F; // "), "p_type").alias("code"))


CODE_SQL = "SELECT p_partkey AS id, concat('::g = @@VAR_', p_partkey % 9, '@@v', p_size, '@@', replace(p_name, ' ', '_'), ' + 0x1F; // ', p_type) AS s FROM part"


@query("b3_tokenize_code_old_names", f"SELECT id AS p_partkey, array_to_string(list_transform(t, lambda x: regexp_replace(x, '^@@\\w+@@(\\w+)@@\\w+$', '@@\\1@@')), ' ') AS tokens FROM ({tokens_sql(CODE_SQL)})")
def b3(spark, d):
    return code_lines(spark, d).select("p_partkey", F.array_join(T.tokenize_code_old_names(F.col("code")), " ").alias("tokens"))


@query("b4_name_view", f"""SELECT id AS p_partkey, array_to_string(t, ' ') AS raw, array_to_string(list_transform(t, lambda x: CASE WHEN starts_with(x, '@@') THEN string_split(x, '@@')[3] ELSE x END), ' ') AS source,
    array_to_string(list_transform(t, lambda x: CASE WHEN starts_with(x, '@@') THEN string_split(x, '@@')[4] ELSE x END), ' ') AS target FROM ({tokens_sql(CODE_SQL)})""")
def b4(spark, d):
    t = code_lines(spark, d).select("p_partkey", T.tokenize_code(F.col("code")).alias("t"))
    return t.select("p_partkey", *(F.array_join(T.name_view(F.col("t"), v), " ").alias(v.lower()) for v in ("RAW", "SOURCE", "TARGET")))


COMMON = "SELECT w FROM (SELECT unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM documents) GROUP BY w ORDER BY count(*) DESC, w LIMIT 20"


def marked(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0).alias("t"))
    # A top-k report of 20 words is what the marking takes.
    common = docs.select(F.explode("t").alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(20).agg(F.collect_list("w").alias("names"))
    return docs.crossJoin(F.broadcast(common)).select("doc_id", T.mark_variables(F.col("t"), F.col("names")).alias("tokens"))


MARKED = f"SELECT doc_id, list_transform(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), lambda x: CASE WHEN list_contains(names, x) THEN concat('@@', x, '@@') ELSE x END) AS t FROM documents, (SELECT list(w) AS names FROM ({COMMON}))"


@query("b5_mark_variables", f"SELECT doc_id, sha256(array_to_string(t, ' ')) AS digest, CAST(len(list_filter(t, lambda x: starts_with(x, '@@'))) AS BIGINT) AS marked FROM ({MARKED})")
def b5(spark, d):
    return marked(spark, d).select("doc_id", F.sha2(F.array_join("tokens", " "), 256).alias("digest"), F.size(F.filter("tokens", lambda t: t.startswith("@@"))).cast("long").alias("marked"))


LINE = f"regexp_extract_all(l, '({TOKENS})', 1)"
ABSTRACT = f"""list_filter(list_transform(list_transform(list_slice(string_split(text, chr(10)), 1, len(string_split(text, chr(10))) - 1),
    lambda l: list_transform(list_filter({LINE}, lambda x: x <> '::'), lambda x: CASE WHEN regexp_matches(x, '^["'']') AND length(x) > 1 THEN '<LITERAL_STRING>' WHEN regexp_matches(x, '^\\.?[0-9]') THEN '<LITERAL_NUMBER>' ELSE x END)),
    lambda n: list_filter(list_filter(n, lambda x, i: NOT (x = '<LITERAL_STRING>' AND i > 1 AND n[i - 1] = '<LITERAL_STRING>')), lambda x, i: i = 1 OR NOT (starts_with(x, '//') OR starts_with(x, '/*')))), lambda y: len(y) > 0)"""


@query("b6_abstract_lines", f"SELECT doc_id, CAST(len(a) AS BIGINT) AS lines, sha256(array_to_string(list_transform(a, lambda y: array_to_string(y, ' ')), chr(10))) AS digest FROM (SELECT doc_id, {ABSTRACT} AS a FROM documents)")
def b6(spark, d):
    a = views.table(spark, d, "documents").select("doc_id", T.abstract_lines(F.col("text")).alias("a"))
    return a.select("doc_id", F.size("a").cast("long").alias("lines"), F.sha2(F.array_join(F.transform("a", lambda y: F.array_join(y, " ")), "\n"), 256).alias("digest"))


@query("b7_hash_context", f"""SELECT id AS p_partkey, array_to_string(list_transform(t, lambda x, i: CASE WHEN starts_with(x, '@@') THEN
    sha256(concat(sha256(concat(sha256(array_to_string(m[1:i - 1], ' ')), x)), array_to_string(m[i:], ' '))) ELSE x END), ' ') AS tokens
    FROM (SELECT id, t, list_transform(t, lambda x: CASE WHEN starts_with(x, '@@') THEN '@@' ELSE x END) AS m FROM ({tokens_sql(CODE_SQL)}))""")
def b7(spark, d):
    return code_lines(spark, d).select("p_partkey", F.array_join(T.hash_context(T.tokenize_code(F.col("code"))), " ").alias("tokens"))


@query("b8_rename_by_table", """SELECT l_orderkey AS func, l_linenumber AS pos, l_partkey, CASE WHEN l_suppkey % 2 = 0 THEN coalesce(p_name, concat('@@VAR_', l_partkey * 2)) ELSE concat('tok', l_suppkey) END AS token
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey * 2""")
def b8(spark, d):
    lines = views.table(spark, d, "lineitem")
    token = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("@@VAR_"), F.col("l_partkey") * 2)).otherwise(F.concat(F.lit("tok"), "l_suppkey"))
    tokens = lines.select(F.struct("l_orderkey", "l_partkey").alias("func"), F.col("l_linenumber").alias("pos"), token.alias("token"))
    names = views.table(spark, d, "part").select(F.col("p_partkey").alias("var"), "p_name")
    return T.rename_by_table(tokens, names, "p_name").select(F.col("func.l_orderkey").alias("func"), "pos", F.col("func.l_partkey").alias("l_partkey"), "token")


@query("b9_normalize_pseudocode", "SELECT doc_id, sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '[ \\t]+', ' ', 'g'), ' ')), chr(10))) AS digest FROM documents")
def b9(spark, d):
    return views.table(spark, d, "documents").select("doc_id", F.sha2(T.normalize_pseudocode(F.col("text")), 256).alias("digest"))


@query("b10_preserved_tokens", f"SELECT DISTINCT token FROM (SELECT unnest(t) AS token FROM ({MARKED})) WHERE starts_with(token, '@@') AND ends_with(token, '@@') AND length(token) > 4")
def b10(spark, d):
    return T.preserved_tokens(marked(spark, d))


@query("b11_argument_ids", "SELECT p_partkey, concat(p_partkey % 9, ',', p_size) AS ids FROM part WHERE p_partkey % 9 <> p_size UNION ALL SELECT p_partkey, CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 9 = p_size")
def b11(spark, d):
    code = F.concat(F.lit("int f(int VAR_"), F.col("p_partkey") % 9, F.lit(", int VAR_"), "p_size", F.lit(")\n{ VAR_77 = VAR_78; }"))
    return views.table(spark, d, "part").select("p_partkey", F.array_join(T.argument_ids(code), ",").alias("ids"))


@query("b12_type_tokens", "SELECT p_partkey, array_to_string(['int', '(', p_type, '*', ')', p_brand[1:5], '[', CAST(p_size AS VARCHAR), ']'], ' ') AS given, array_to_string(['int', p_type, '*', 'Brand', '[', CAST(p_size AS VARCHAR), ']'], ' ') AS tokens FROM part")
def b12(spark, d):
    kind = F.concat(F.lit("__int ("), "p_type", F.lit("*) _Brand["), "p_size", F.lit("]"))
    given = F.concat(F.lit("int ( "), "p_type", F.lit(" * ) "), F.substring("p_brand", 1, 5), F.lit(" [ "), "p_size", F.lit(" ]"))
    return views.table(spark, d, "part").select("p_partkey", given.alias("given"), F.array_join(T.type_tokens(kind), " ").alias("tokens"))


@query("b13_is_placeholder", "SELECT p_partkey, p_size % 2 = 0 AS marked, CASE WHEN p_size % 2 = 0 THEN p_brand END AS inner_name FROM part")
def b13(spark, d):
    token = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("@@"), "p_brand", F.lit("@@"))).otherwise(F.concat(F.lit("@@"), "p_brand"))
    return views.table(spark, d, "part").select("p_partkey", T.is_placeholder(token).alias("marked"), F.when(T.is_placeholder(token), T.placeholder_name(token)).alias("inner_name"))
