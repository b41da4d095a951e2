"""The registered queries of this package, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_bpe, hard_negatives, minhash, mixing, multiprobe, ngram_join, piece_counts, quartile_digest, style_tree, subwords, toxic_spans, warc_zst
from .common import cut, held_out, table

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_50k.json"
#: Least scores of the classes.
GOOD, TOXIC = 0.3, 0.5


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_zst.with_revisits(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    archives = cut(warc_zst.write_archives(records))
    return warc_zst.read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op3_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return toxic_spans.tag(docs, toxic_spans.fit(docs, labels, "toxic"), threshold=TOXIC)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return subwords.score(docs, subwords.fit(docs, labels, "quality"), threshold=GOOD)


def op5_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")


def op6_quality_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, table(spark, sf_dir, "labels")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quartile_digest.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(PIECES))


def op10_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiprobe.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = alignment.align_corpus(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES), public_tokenizers.PATTERN)
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_sets(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_main_text, op2_warc_records, op3_entropy_mix, op4_byte_bpe, op5_toxic_spans, op6_quality_subwords, op7_minhash_dedup, op8_quartile_digest, op9_token_counts, op10_multiprobe_neighbours, op11_token_alignment, op12_ngram_join, op13_hard_negatives)
}

ORACLE_SQL: dict[str, str] = {
    # What the archives hold is a join of the pages with themselves; packing and reading leave no trace in it.
    "op2_warc_records": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT d.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
               CASE WHEN d.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN d.page_id > f.first THEN f.first END AS refers_to, CAST(NULL AS VARCHAR) AS error
        FROM d LEFT JOIN f USING (payload_digest)""",
    "op12_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
                                  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
        n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s), x AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS n, count(*) AS k FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
        l AS (SELECT a, b FROM c WHERE 100 * k >= 85 * (n - k)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
        SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n""",
    "op13_hard_negatives": """
        WITH u AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
              FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
