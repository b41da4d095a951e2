"""Scans, sources and sinks."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan_functions(spark: SparkSession, path: str, corrupt: bool = False) -> DataFrame:
    """``file, line_no, json`` of gzip JSON lines, a file a binary; blank lines are left out but count.

    A gzip file is read by one task in order, which numbers its lines as they pass.  With ``corrupt``, broken files
    give the lines before the break.
    """
    reader = spark.read.option("ignoreCorruptFiles", str(corrupt).lower()).option("recursiveFileLookup", "true")
    lines = reader.text(path).select(F.regexp_replace(F.col("_metadata.file_path"), r"\.gz$", "").alias("file"), F.col("value").alias("json"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            files = batch.column("file").to_pylist()
            numbers = np.empty(len(files), np.int64)
            starts = [i for i in range(len(files)) if i == 0 or files[i] != files[i - 1]]
            for i, j in zip(starts, [*starts[1:], len(files)]):
                if files[i] != last:
                    last, n = files[i], 0
                numbers[i:j] = np.arange(n, n + j - i)
                n += j - i
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(numbers), batch.column("json")], names=["file", "line_no", "json"])

    return lines.mapInArrow(number, "file string, line_no long, json string").where(F.trim("json") != "")


def skip_corrupt_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The lines that can be read, those before a break too, and every file that doesn't decompress to its end."""

    def broken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = [not _whole_gzip(content.as_buffer()) for content in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("file").filter(pa.array(bad, pa.bool_()))], names=["file"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_replace("path", r"\.gz$", "").alias("file"), "content")
    return scan_functions(spark, path, corrupt=True), files.mapInArrow(broken, "file string")


def _whole_gzip(content: pa.Buffer) -> bool:
    """Whether all members decompress, a part at a time; a file without content is whole."""
    data, step = memoryview(content), zlib.decompressobj(31)
    try:
        for at in range(0, len(data), 1 << 20):
            rest = data[at : at + (1 << 20)]
            while len(rest):
                if step.eof:
                    step = zlib.decompressobj(31)
                step.decompress(rest)
                rest = step.unused_data
    except zlib.error:
        return False
    return step.eof or not len(data)


def select_inputs(files: DataFrame, listed: DataFrame, most: int) -> DataFrame:
    """The first ``most`` listed names (place, name) that end in .gz, of those that there are."""
    kept = listed.where(F.col("name").endswith(".gz")).orderBy("place").limit(most)
    return files.join(kept.select("name"), "name", "left_semi")


def drop_malformed(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose JSON parses, and the others."""
    # As the only member of a list, so that text after the document shows.
    listed = F.concat(F.lit("["), F.col(column), F.lit("]"))
    good = F.coalesce(F.try_parse_json(listed).isNotNull() & (F.json_array_length(listed) == 1), F.lit(False))
    return rows.where(good), rows.where(~good)


def binary_key(file: Column, rule: str = "prefix") -> Column:
    """Text before the first underscore, the first 64 characters, or the name without .gz."""
    return {"prefix": F.substring_index(file, "_", 1), "hash": F.substring(file, 1, 64), "name": F.regexp_replace(file, r"\.gz$", "")}[rule]


def json_archive_to_lines(members: DataFrame) -> DataFrame:
    """Each member of an archive, a whole JSON document in members(member, text), as one compact line."""

    def compact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"member": frame["member"], "json": [json.dumps(json.loads(x), separators=(",", ":"), ensure_ascii=False) for x in frame["text"]]})

    return members.select("member", "text").mapInPandas(compact, "member string, json string")


def group_by_binary(lines: DataFrame) -> DataFrame:
    """The lines of each member in order."""
    return lines.groupBy("member").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "json"))), lambda x: x["json"]).alias("lines"))


def shard_prefix(shards: DataFrame, share: float) -> DataFrame:
    """The first int(share n) of the shards by name; a row a shard."""
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    return shards.withColumn("_r", F.row_number().over(Window.orderBy("shard"))).withColumn("_n", n).where(F.col("_r") <= F.floor(F.col("_n") * share)).drop("_r", "_n")


def assign_shards(bins: DataFrame, size: int) -> DataFrame:
    """``shard_id`` of bins(bin, split): runs of so many binaries of train; the other splits are a shard each."""
    run = F.floor((F.row_number().over(Window.partitionBy("split").orderBy("bin")) - 1) / size)
    return bins.withColumn("shard_id", F.when(F.col("split") == "train", run).otherwise(0).cast("long"))


def read_typelib(lines: DataFrame) -> DataFrame:
    """``size, freq, type_json`` of libraries {size: [[freq, type], ...], "T": 0}; the tag is skipped."""
    sizes = lines.select(F.explode(F.from_json("json", "map<string,string>")).alias("size", "entries")).where("size <> 'T'")
    each = sizes.select(F.col("size").cast("long").alias("size"), F.explode(F.from_json("entries", "array<array<string>>")).alias("e"))
    return each.select("size", F.get("e", F.lit(0)).cast("long").alias("freq"), F.get("e", F.lit(1)).alias("type_json"))


def write_typelib(rows: DataFrame) -> DataFrame:
    """One compact line a library of rows(lib, size, freq, type_json), sizes and entries in order."""
    entry = F.concat(F.lit("["), "freq", F.lit(","), "type_json", F.lit("]"))
    sizes = rows.groupBy("lib", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("f"), "type_json", entry.alias("e")))), lambda x: x["e"]).alias("entries"))
    text = F.concat(F.lit('"'), "size", F.lit('":['), F.array_join("entries", ","), F.lit("]"))
    all_ = sizes.groupBy("lib").agg(F.transform(F.array_sort(F.collect_list(F.struct("size", text.alias("t")))), lambda x: x["t"]).alias("t"))
    return all_.select("lib", F.concat(F.lit("{"), F.array_join("t", ","), F.lit(',"T":0}')).alias("json"))


def load_typelib_dir(spark: SparkSession, path: str) -> DataFrame:
    """All libraries of a folder, equal entries added up."""
    return merge_read(spark.read.text(path).withColumnRenamed("value", "json"))


def merge_read(lines: DataFrame) -> DataFrame:
    return read_typelib(lines).groupBy("size", "type_json").agg(F.sum("freq").alias("freq"))


def write_predictions(rows: DataFrame, order: str) -> DataFrame:
    """A JSON map function -> variable -> [type, name] a binary of rows(bin, func, var, pred_type, pred_name); later rows win."""
    last = rows.groupBy("bin", "func", "var").agg(F.max_by(F.array("pred_type", "pred_name"), order).alias("p"))
    functions = last.groupBy("bin", "func").agg(F.map_from_entries(F.collect_list(F.struct("var", "p"))).alias("v"))
    return functions.groupBy("bin").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("func").cast("string"), "v")))).alias("json"))


def read_predictions(lines: DataFrame) -> DataFrame:
    """The inverse, of lines(bin, json)."""
    functions = lines.select("bin", F.explode(F.from_json("json", "map<string,map<string,array<string>>>")).alias("func", "v"))
    return functions.select("bin", "func", F.explode("v").alias("var", "p")).select("bin", "func", "var", F.get("p", F.lit(0)).alias("pred_type"), F.get("p", F.lit(1)).alias("pred_name"))


def save_vocab(vocab: DataFrame, path: str) -> None:
    vocab.write.partitionBy("vocab").parquet(path)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def list_elf64(files: DataFrame, content: str = "content") -> DataFrame:
    """Files that begin like a 64-bit object file."""
    return files.where(F.substring(content, 1, 5) == F.expr("X'7F454C4602'"))


def content_key(content: Column, name: Column) -> Column:
    return F.concat(F.sha2(content, 256), F.lit("_"), name)


def exact_dedup(rows: DataFrame, content: str, name: str) -> DataFrame:
    """The first name of each content; digests are shuffled, not contents."""
    digest = F.sha2(content, 256)
    return rows.groupBy(digest.alias("digest")).agg(F.min(name).alias(name))


def skip_done(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    return inputs.join(outputs.select(key), key, "left_anti")


def token_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.array_join("tokens", " ").alias("value"))


def name_frequencies(variables: DataFrame) -> DataFrame:
    """Names with their counts; written in the order of descending count."""
    return variables.groupBy(F.col("new_name").alias("name")).agg(F.count("*").alias("freq"))


def export_name_freq(variables: DataFrame, path: str) -> None:
    name_frequencies(variables).orderBy(F.desc("freq"), "name").write.csv(path, sep="\t")


def export_names(variables: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Changed target names and identifiers, one a line."""
    changed = variables.where(F.col("old_name") != F.col("new_name")).select(F.col("new_name").alias("value"))
    return changed.unionByName(identifiers.select(F.col("identifier").alias("value")))


def subsample_binaries(bins: DataFrame, ratio: float, seed: str) -> DataFrame:
    """Exactly int(ratio n) distinct binaries in the order of a seeded hash; a row a binary."""
    order = Window.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "bin"), 256), "bin")
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    return bins.withColumn("_r", F.row_number().over(order)).withColumn("_n", n).where(F.col("_r") <= F.floor(F.col("_n") * ratio)).drop("_r", "_n")


def metrics_json(report: DataFrame) -> DataFrame:
    """One flat line of metrics; nulls stay in it."""
    return report.select(F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("value"))
