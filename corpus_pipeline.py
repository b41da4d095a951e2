"""The corpus pipeline: quality, toxicity, near duplicates, mixing, and tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelore.llm import byte_bpe, minhash, mixing, queries
from codelore.llm.common import shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return queries.quality(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the span tagger finds toxic go."""
    return queries.toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; rows of one doc_id are one only if their sets of shingles are equal."""
    kept = minhash.labelled(docs.select("doc_id", "text")).where(F.col("kept") & F.col("doc_id").isNotNull())
    kept = kept.groupBy("doc_id", "fp").agg(F.min("h").alias("_h")).select("doc_id", "_h")
    rows = docs.where(F.col("doc_id").isNotNull()).withColumn("_h", F.xxhash64("text")).join(kept, ["doc_id", "_h"], "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = rows.groupBy("doc_id", "_h").agg(F.min(F.struct(*rest, "text")).alias("_r")).select("doc_id", "_r.*")
    return first.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row stands as many times as the mix takes it.

    The mix decides by doc_id, source and size, nulls included, so that rows alike in all three stand equally often; a row
    that it doesn't take, or one without words, goes.  Columns of any other name come along whatever they are called.
    """
    key = ("doc_id", "source", "size")
    taken = mixing.mix(docs).where("copies > 0").groupBy(*key).agg(F.max("copies").cast("int").alias("copies")).select(F.struct(*key).alias("of"), "copies")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.struct("doc_id", "source", mixing.word_count("text").alias("size")).alias("key"))
    met = rows.join(taken, F.col("key").eqNullSafe(F.col("of")))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each document's tokens."""
    return byte_bpe.digests(docs, public_tokenizers.path(queries.BPE_RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxicity),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

#: The stages learn, hash and tokenise, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
