"""Helpers the corpus operators share: the shared folder, row keys, ordered buckets, words.

Conventions of all operators in this package
- A document is a row with ``doc_id`` and ``text``; further columns pass through or are ignored.
- A null text counts as the empty text, a null ``doc_id`` as the smallest id.
- Rows that repeat a ``doc_id`` with the same text are copies of one document: each row gets the same
  result. Internal columns start with ``__`` and never reach a result; where a result column has the
  name of an input column that is not asked for, the result column wins.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A word: characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Most buckets of an ordering; tables with a row per bucket are bounded by it.
MAX_BUCKETS = 65536
BUCKET_ROWS = 1024

SMALLEST = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a private one only in local runs."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, *partition_by: str, **options: object) -> DataFrame:
    """The rows written as a table of the shared folder and read again: computed once, lineage cut.

    Lost executors do not lose it; each call writes a folder of its own. ``options`` are the writer's.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.options(compression="zstd", **options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def id_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("bigint"), F.lit(SMALLEST))


def packed(docs: DataFrame) -> DataFrame:
    """(__row, __id, __crc): whole rows under one name, so that no column of theirs clashes, and their key."""
    row = F.struct(*[docs[c] for c in docs.columns])
    return docs.select(row.alias("__row"), id_of(docs).alias("__id"), F.crc32(text_of(docs).cast("binary")).alias("__crc"))


def words_of(text: Column) -> Column:
    """Words of a text as an array; empty for a text without words."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def order_buckets(docs: DataFrame) -> tuple[Column, int]:
    """An expression that puts ids into at most ``MAX_BUCKETS`` ranges of ascending ids, and their number.

    Two numbers decide the width (range and count of ids), so evenly spread ids fill the buckets evenly.
    Clustered ids fill them unevenly; a bucket is then sorted on disk like any other window.
    """
    low, high, n = docs.agg(F.min(id_of(docs)), F.max(id_of(docs)), F.count(F.lit(1))).first()
    if not n:
        return F.lit(0).cast("bigint"), 1
    low_real = max(low, -(2**62))
    buckets = max(1, min(MAX_BUCKETS, -(-n // BUCKET_ROWS)))
    width = max(1, -(-(min(high, 2**62) - low_real + 1) // buckets))
    place = F.floor((id_of(docs) - F.lit(low_real)) / F.lit(float(width))).cast("bigint")
    return F.when(id_of(docs) < low_real, 0).otherwise(F.least(place, F.lit(buckets - 1))), buckets


def offsets(counts: DataFrame, keys: list[str], bucket: str, value: str, out: str) -> DataFrame:
    """Running total of ``value`` before each bucket; one row per bucket goes in."""
    w = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
