"""Durable cuts of lineage for loops, and rows dealt over as many tasks as they need."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame

#: Rows of a task, on average: what a task sorts and groups doesn't grow with the tables.
ROWS = 250_000


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the session names; one of our own only in local mode, where all share one disk."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def dealt(rows: DataFrame, many: int, *keys: str) -> DataFrame:
    """Rows by their keys over tasks of ``ROWS`` each, if there are so many.

    Spark joins partitions of its own choice by their bytes on disk, which narrow rows have few of and need many times over
    once they are sorted or grouped; a number that is asked for stays.  What is grouped by the keys or more stays in its task.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, 1 + many // ROWS), *keys)
