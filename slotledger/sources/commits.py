"""Runs and commits: how tables on a plain file store are changed while others read and write them.

A run writes its rows into a folder of its own and then one small commit row for each part (a month, a forecast) it stands for. Rows without a
commit do not exist for readers, so a run that dies in between leaves nothing visible. No folder is overwritten or renamed, so a reader
keeps what it has begun to read. Commits count in the order of their files' times on the store, then of their run names; rules over this order,
which every reader applies alike, decide what the table holds. Nothing needs a lock.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEQUENCE = ["committed_at", "run"]


def new_run() -> str:
    return uuid.uuid4().hex


def stored_schema(df: DataFrame) -> str:
    """Columns of a frame as the readers below take them."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def write_run(rows: DataFrame, path: str, run: str, partition: Sequence[str] = ()) -> None:
    """The rows of a run; not visible before its commit."""
    writer = rows.write.mode("error")
    (writer.partitionBy(*partition) if partition else writer).parquet(f"{path}/runs/run={run}")


def commit(parts: DataFrame, path: str, run: str) -> None:
    """Commit rows of a run, in one file: all become visible together. A folder for each run, because jobs that write one folder clash.

    The rows cross an exchange: merged into one task without it, the plan before them would hold the memory of all its partitions there.
    """
    parts.repartition(1).write.mode("error").parquet(f"{path}/commits/run={run}")


def read_commits(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All commits with their time; none where nothing was committed yet."""
    try:
        rows = spark.read.schema(f"{schema}, run string").parquet(f"{path}/commits")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        return spark.createDataFrame([], f"{schema}, run string, committed_at timestamp")
    return rows.select("*", F.col("_metadata.file_modification_time").alias("committed_at"))


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all runs with their ``run``, committed or not; ``schema`` names the stored columns, partitions included."""
    try:
        return spark.read.schema(f"{schema}, run string").parquet(f"{path}/runs")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        return spark.createDataFrame([], f"{schema}, run string")
