"""Queries over vocabularies and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelore.functions import ctypes as C
from codelore.operators import vocab as V
from codelore.operators.lineage import cut
from codelore.plans import views
from codelore.plans.register import query
from codelore.plans.stats import WORDS, word_counts
from codelore.plans.typelib import LIB, library, structs
from codelore.plans.views import sql

SPECIAL = "(VALUES ('<pad>', 0), ('<s>', 1), ('</s>', 2), ('<unk>', 3), ('<IDENTITY>', 4))"


def vocab_sql(counts: str, size: int, cutoff: int) -> str:
    return f"""SELECT word, CAST(id AS BIGINT) AS id, CAST(NULL AS BIGINT) AS freq FROM {SPECIAL} s(word, id)
        UNION ALL SELECT word, rn + 4, CAST(freq AS BIGINT) FROM (SELECT word, freq, row_number() OVER (ORDER BY freq DESC, word) AS rn FROM ({counts}) WHERE freq >= {cutoff}) WHERE rn <= {size - 5}"""


@query("f1_vocab_from_counts", vocab_sql(WORDS, 500, 3))
def f1(spark, d):
    return V.vocab_from_counts(word_counts(spark, d), 500, 3)


@query("f2_count_types", f"SELECT type_str AS word, CAST(sum(freq) AS BIGINT) AS freq FROM ({LIB}) GROUP BY 1")
def f2(spark, d):
    return V.count_types(library(spark, d))


@query("f3_count_subtypes", sql("""SELECT word, count(*) AS freq FROM (SELECT CASE WHEN padding THEN concat('PADDING (', size, ')') ELSE concat(src_type, ' ', old_name) END AS word FROM v2
    UNION ALL SELECT unnest(['<struct>', concat('s', func), '<eot>']) FROM (SELECT DISTINCT func FROM v2)) GROUP BY word""", "v2"))
def f3(spark, d):
    return V.count_tokens(structs(spark, d).select(C.tokenize_type(F.col("type")).alias("t")), "t")


NAMES = "SELECT new_name AS word, count(*) AS freq FROM v2 GROUP BY 1"


@query("f4_count_names", sql(NAMES, "v2"))
def f4(spark, d):
    return V.count_names(views.variables(spark, d))


@query("f5_count_registers", sql("SELECT loc[2:] AS word, count(*) AS freq FROM v2 WHERE starts_with(loc, 'r') GROUP BY 1", "v2"))
def f5(spark, d):
    return V.count_registers(views.variables(spark, d))


@query("f6_encode_decode", sql(f"SELECT func, pos, new_name, coalesce(v.id, 3) AS id, w.word FROM v2 LEFT JOIN ({vocab_sql(NAMES, 12, 1)}) v ON v.word = new_name LEFT JOIN ({vocab_sql(NAMES, 12, 1)}) w ON w.id = coalesce(v.id, 3)", "v2"))
def f6(spark, d):
    v = views.variables(spark, d).select("func", "pos", "new_name")
    words = V.vocab_from_counts(V.count_names(v), 12, 1)
    return V.decode(V.encode(v, "new_name", words), "id", words).select("func", "pos", "new_name", "id", "word")


@query("f7_lookup_decompiler_type", sql(f"""SELECT func, pos, tgt_type, coalesce(v.id, w.id, 3) AS id FROM v2 LEFT JOIN ({vocab_sql("SELECT src_type AS word, count(*) AS freq FROM v2 GROUP BY 1", 50, 1)}) v ON v.word = tgt_type
    LEFT JOIN ({vocab_sql("SELECT src_type AS word, count(*) AS freq FROM v2 GROUP BY 1", 50, 1)}) w ON starts_with(tgt_type, 'struct ') AND w.word = tgt_type[8:]""", "v2"))
def f7(spark, d):
    v = views.variables(spark, d).select("func", "pos", "src_type", "tgt_type")
    words = V.vocab_from_counts(v.groupBy(F.col("src_type").alias("word")).agg(F.count("*").alias("freq")), 50, 1)
    return V.lookup_decompiler_type(v, "tgt_type", words).select("func", "pos", "tgt_type", "id")


@query("f8_encode_memory", sql("""SELECT func, array_to_string(list_transform(list_concat(starts, [1024, 1025])[1:128], lambda v: CASE WHEN v > 1024 THEN 2 ELSE v + 3 END), ',') || ',1' AS codes FROM layouts WHERE len(starts) < 120""", "layouts"))
def f8(spark, d):
    values = F.concat(F.transform(C.start_offsets(F.col("type")), lambda v: v.cast("string")), F.array(F.lit("1024"), F.lit("1025"), F.lit("<SEP>")))
    return structs(spark, d).select("func", F.array_join(F.transform(V.encode_memory(values), lambda v: v.cast("string")), ",").alias("codes"))


LOCATION = "SELECT func, pos, size, CASE WHEN starts_with(loc, 'r') THEN 1030 + CAST(loc[2:] AS BIGINT) WHEN m - CAST(loc[2:] AS BIGINT) >= 1024 THEN 2 ELSE 3 + m - CAST(loc[2:] AS BIGINT) END AS code FROM (SELECT *, max(CASE WHEN starts_with(loc, 's') THEN CAST(loc[2:] AS BIGINT) END) OVER (PARTITION BY func) AS m FROM v2)"


@query("f9_encode_location", sql(f"SELECT func, pos, code FROM ({LOCATION})", "v2"))
def f9(spark, d):
    return V.encode_location(views.variables(spark, d)).select("func", "pos", "code")


@query("f10_layout_vector", sql(f"SELECT func, pos, concat(code, ',', size + 3, ',3') AS vector FROM ({LOCATION})", "v2"))
def f10(spark, d):
    rows = V.encode_location(views.variables(spark, d))
    vector = V.layout_vector(F.col("code"), F.col("size"), F.array(F.lit(0).cast("long")))
    return rows.select("func", "pos", F.array_join(F.transform(vector, lambda v: v.cast("string")), ",").alias("vector"))




@query("f11_bpe_pair_counts", f"SELECT c AS \"left\", n2 AS \"right\", CAST(sum(freq) AS BIGINT) AS n FROM (SELECT freq, word[i] AS c, word[i + 1] AS n2 FROM (SELECT word, freq, unnest(range(1, length(word))) AS i FROM ({WORDS}))) GROUP BY ALL")
def f11(spark, d):
    return V.pair_counts(word_counts(spark, d).select(V.parted(F.col("word")).alias("p"), "freq"))


#: Merges that are learnt, and texts that no merge reaches into.
MERGES, MARKED = 24, ["License", "://", "@"]
PIECE_MARKS = "replace(replace(replace(word, 'License', '\ufdd2License\ufdd2'), '://', '\ufdd2://\ufdd2'), '@', '\ufdd2@\ufdd2')"
# Every state of every part of a word, merge by merge; parts stand between marks, and one that is a single piece is done.
BPE_STEPS = f"""words AS ({WORDS}),
    segments AS (SELECT word, freq, i, s[i] AS segment FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (SELECT word, freq, list_filter(string_split({PIECE_MARKS}, '\ufdd2'), lambda x: x <> '') AS s FROM words))),
    begun AS (SELECT segment, CAST(sum(freq) AS BIGINT) AS freq FROM segments WHERE segment NOT IN ('License', '://', '@') GROUP BY segment),
    steps(rank, segment, p, freq, l, r) AS (SELECT CAST(-1 AS BIGINT), segment, '\ufdd0' || array_to_string(string_split(segment, ''), '\ufdd1\ufdd0') || '\ufdd1', freq, '', '' FROM begun
    UNION ALL SELECT s.rank + 1, s.segment, replace(s.p, '\ufdd0' || b.l || '\ufdd1\ufdd0' || b.r || '\ufdd1', '\ufdd0' || b.l || b.r || '\ufdd1'), s.freq, b.l, b.r FROM steps s,
    (SELECT l, r FROM (SELECT x[i] AS l, x[i + 1] AS r, freq FROM (SELECT x, freq, unnest(range(1, len(x))) AS i FROM (SELECT string_split(p[2:length(p) - 1], '\ufdd1\ufdd0') AS x, freq FROM steps))) GROUP BY l, r ORDER BY sum(freq) DESC, l, r LIMIT 1) b
    WHERE s.rank < {MERGES - 1} AND contains(s.p, '\ufdd1\ufdd0')),
    learnt AS (SELECT DISTINCT rank, l, r FROM steps WHERE rank >= 0)"""


@query("f11_learn_bpe", f'WITH RECURSIVE {BPE_STEPS} SELECT rank, l AS "left", r AS "right" FROM learnt')
def f11_loop(spark, d):
    return V.learn_bpe(word_counts(spark, d), MERGES, MARKED)


PIECES = """fixed(id, piece) AS (VALUES (4, 'License'), (5, '://'), (6, '@')),
    vocab AS (SELECT id, piece FROM fixed UNION ALL SELECT 6 + row_number() OVER (ORDER BY kind DESC, place, piece), piece FROM (SELECT 'merge' AS kind, l || r AS piece, min(rank) AS place FROM learnt GROUP BY 2
    UNION ALL SELECT 'char', c, -sum(freq) FROM (SELECT freq, unnest(string_split(segment, '')) AS c FROM begun) GROUP BY c)),
    done AS (SELECT segment, arg_max(string_split(p[2:length(p) - 1], '\ufdd1\ufdd0'), rank) AS x FROM steps GROUP BY segment UNION ALL SELECT piece, [piece] FROM fixed),
    pieces AS (SELECT word, i, unnest(x) AS piece, unnest(range(1, len(x) + 1)) AS j FROM segments JOIN done USING (segment))"""


@query("f12_apply_bpe", f"WITH RECURSIVE {BPE_STEPS}, {PIECES} SELECT word, string_agg(piece, '|' ORDER BY i, j) AS pieces, string_agg(CAST(id AS VARCHAR), ',' ORDER BY i, j) AS ids FROM pieces JOIN vocab USING (piece) GROUP BY word")
def f12(spark, d):
    words = cut(word_counts(spark, d))  # read by four steps
    merges = cut(V.learn_bpe(words, MERGES, MARKED))
    rows = V.apply_bpe(words, "word", merges, marked=MARKED, vocab=V.bpe_vocab(words, merges, MARKED))
    return rows.select("word", F.array_join("pieces", "|").alias("pieces"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query("f13_truncate_wrap", "SELECT doc_id, sha256(concat('<s> ', array_to_string(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')[1:50], ' '), ' </s>')) AS digest, least(50, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) + 2 AS n FROM documents WHERE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) > 0")
def f13(spark, d):
    pieces = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    rows = views.table(spark, d, "documents").where(F.size(pieces) > 0).select("doc_id", V.truncate_wrap(pieces, 50).alias("p"))
    return rows.select("doc_id", F.sha2(F.array_join("p", " "), 256).alias("digest"), F.size("p").cast("long").alias("n"))


@query("f14_target_pieces", sql("""SELECT func, pos, array_to_string(p, ' ') AS pieces, CAST(sum(len(p)) OVER (PARTITION BY func) AS BIGINT) AS total FROM (
    SELECT func, pos, CASE WHEN old_name = new_name THEN ['<IDENTITY>', '</s>'] ELSE list_append(string_split(new_name, '_'), '</s>') END AS p FROM v2)""", "v2"))
def f14(spark, d):
    return V.target_pieces(views.variables(spark, d)).select("func", "pos", F.array_join("pieces", " ").alias("pieces"), "total")


@query("f15_build_grammar", """SELECT 'node' AS kind, event_type AS word, row_number() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events)
    UNION ALL SELECT 'type', p_type, row_number() OVER (ORDER BY p_type) + 1 FROM (SELECT p_type FROM part GROUP BY p_type HAVING count(*) > 30) UNION ALL SELECT 'type', '<pad>', 0 UNION ALL SELECT 'type', '<unk>', 1""")
def f15(spark, d):
    nodes = views.table(spark, d, "events").select(F.col("event_type").alias("node_type"))
    types = views.table(spark, d, "part").groupBy(F.col("p_type").alias("word")).agg(F.count("*").alias("freq"))
    return V.build_grammar(nodes, types, 30).select("kind", "word", "id")


SUBTYPES = "SELECT CASE WHEN padding THEN concat('PADDING (', size, ')') ELSE concat(src_type, ' ', old_name) END AS word, count(*) AS freq FROM v2 GROUP BY 1"


@query("f16_subtype_ids", sql(f"""SELECT func, string_agg(CAST(coalesce(v.id, 3) AS VARCHAR), ',' ORDER BY pos) AS ids, count(*) AS n FROM (
    SELECT func, pos, CASE WHEN padding THEN concat('PADDING (', size, ')') ELSE concat(src_type, ' ', old_name) END AS word FROM v2) LEFT JOIN ({vocab_sql(SUBTYPES, 30, 1)}) v USING (word) GROUP BY func""", "v2"))
def f16(spark, d):
    tokens = structs(spark, d).select("func", F.posexplode(F.slice(C.tokenize_type(F.col("type")), F.lit(3), F.size(F.col("type")["l"]))).alias("pos", "word"))
    words = V.vocab_from_counts(tokens.groupBy("word").agg(F.count("*").alias("freq")), 30, 1)
    rows = V.encode(tokens, "word", words)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"].cast("string")), ",")
    return rows.groupBy("func").agg(ids.alias("ids"), F.count("*").alias("n"))


@query("f17_source_word_counts", sql("SELECT word, count(*) AS freq FROM (SELECT old_name AS word FROM v2 UNION ALL SELECT new_name FROM v2 WHERE old_name <> new_name) GROUP BY word", "v2"))
def f17(spark, d):
    return V.source_word_counts(views.variables(spark, d))
