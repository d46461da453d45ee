"""Operator 1: shards by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked. The fractional rank (rank + 1/2) / rows of
the source puts all sources on one scale; sorted by it, any run of rows matches the mixture, and equal
cuts of that order are the shards. The law that holds is ``rows``: counts of shards differ by at most one.

Defined results: a null source is a stratum of its own; a null or empty text has size 8; rows that tie
completely are interchangeable; an empty table gives no rows; more shards than rows leave shards empty.

Scale: texts never move; only (id, source, size, checksum) is shuffled, twice. No source is one group: ranks
are offsets of hash buckets plus the place inside a bucket, so a source with a third of all rows is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slotledger.llm.common import MAX_BUCKETS, documents, id_of, offsets, stored, text_of

SHARDS = 24
SEED = "epoch-1"
#: Rows a bucket of the order should hold.
BUCKET = 20_000


def shuffle_key(doc_id: Column, crc: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string"), crc.cast("string")).cast("binary"))


def slim(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, crc, key) of each row; the only pass over texts."""
    data = text_of(docs).cast("binary")
    crc = F.crc32(data)
    return docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"),
        docs["source"].cast("string").alias("__source"),
        (F.octet_length(data) + 8).cast("bigint").alias("size"),
        crc.alias("text_crc32"),
        shuffle_key(id_of(docs), crc, seed).alias("__key"),
    )


def ranked(rows: DataFrame, n_buckets: int) -> DataFrame:
    """Adds the rank within the source (from 0, by key) and the rows of the source."""
    bucket = F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("bigint") * n_buckets / 2**32).cast("int")
    rows = rows.withColumn("__bucket", bucket)
    counts = rows.groupBy("__source", "__bucket").agg(F.count(F.lit(1)).alias("__in"))
    counts = offsets(counts, ["__source"], "__bucket", "__in", "__before")
    counts = counts.withColumn("__total", F.sum("__in").over(W.partitionBy("__source")))
    right = counts.select(F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), "__before", "__total")
    joined = rows.join(right, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    order = W.partitionBy("__source", "__bucket").orderBy("__key", "doc_id")
    rank = F.col("__before") + F.row_number().over(order) - 1
    return joined.withColumn("__rank", rank).drop("__s", "__b", "__before")


def placed(rows: DataFrame, n_cells: int) -> DataFrame:
    """Adds the place in the order of fractional ranks (from 0)."""
    share = (F.col("__rank") * 2 + 1).cast("double") / (F.col("__total") * 2).cast("double")
    rows = rows.withColumn("__share", share).withColumn("__cell", F.floor(share * n_cells).cast("int"))
    counts = rows.groupBy("__cell").agg(F.count(F.lit(1)).alias("__in"))
    counts = offsets(counts, [], "__cell", "__in", "__before")  # a row per cell, at most MAX_BUCKETS
    right = counts.select(F.col("__cell").alias("__c"), "__before")
    order = W.partitionBy("__cell").orderBy("__share", F.col("__source").asc_nulls_first(), "__key")
    joined = rows.join(right, F.col("__cell") == F.col("__c"))
    return joined.withColumn("__place", F.col("__before") + F.row_number().over(order) - 1)


def interleaved_shards(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, source."""
    rows = stored(slim(docs, seed), "shard-rows")
    n = rows.count()
    n_buckets = max(1, min(MAX_BUCKETS, -(-n // BUCKET)))
    out = placed(ranked(rows, n_buckets), n_buckets)
    shard = F.expr(f"__place * {shards} div {max(n, 1)}").cast("int")
    first = F.expr(f"(shard * cast({max(n, 1)} as bigint) + {shards - 1}) div {shards}")
    return (
        out.withColumn("shard", shard)
        .withColumn("slot", (F.col("__place") - first).cast("bigint"))
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
            F.lit(None).cast("int").alias("grown_shard"), F.col("__source").alias("source"),
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    return interleaved_shards(documents(spark, sf_dir))


#: CRC-32 table by its rule, then one step per byte.
_TABLE = """(SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""

ORACLE_SQL = f"""WITH crc AS {_TABLE},
bytes AS (SELECT doc_id, source, coalesce(text, '') AS text,
    list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM documents),
slim AS (SELECT doc_id, source, strlen(text) + 8 AS size,
    xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS text_crc32
  FROM bytes, crc),
ranked AS (SELECT *, md5('{SEED}:' || doc_id || ':' || text_crc32) AS key FROM slim),
share AS (SELECT *, (2 * (row_number() OVER (PARTITION BY source ORDER BY key, doc_id) - 1) + 1)::DOUBLE
    / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS share FROM ranked),
place AS (SELECT *, row_number() OVER (ORDER BY share, source NULLS FIRST, key) - 1 AS p, count(*) OVER () AS n FROM share)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(p * {SHARDS} // n AS INTEGER) AS shard,
  p - ((p * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard, source
FROM place"""
