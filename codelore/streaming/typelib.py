"""The type library kept up to date as function records arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from codelore.operators import typelib


def variables_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """New Parquet files of variables in a folder, at most ``files`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def update_typelib(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add the frequencies of each arriving batch of variables(size, type_str) to the library at ``path``.

    A batch's own library is written under its number, so that one that runs again after a failure replaces itself; reading adds the
    batches up.
    """

    def add(batch: DataFrame, number: int) -> None:
        typelib.build_typelib(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()


def read_typelib(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path).drop("batch")
    return typelib.merge_typelibs(rows, rows.limit(0))
