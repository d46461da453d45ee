"""Price chunks as a file stream merged into the month archive.

Revisions must win over what is archived, so each micro-batch goes through the same upsert as the
batch job instead of a streaming de-duplication, which would keep the first value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slotledger.config import LedgerConfig
from slotledger.operators.observations import latest_wins
from slotledger.sources.archive import local_month
from slotledger.sources.feeds import parse_price_chunks
from slotledger.sources.versions import MonthArchive

LANDED_SCHEMA = "series_id string, payload string, ingested_at timestamp"
ARCHIVE_SCHEMA = "series_id string, slot_utc timestamp, value double, ingested_at timestamp, month string"


def price_archive(spark: SparkSession, path: str) -> MonthArchive:
    return MonthArchive(spark, path, ARCHIVE_SCHEMA, ["series_id", "slot_utc"], ["value", "ingested_at"])


def merge_batch(archive_path: str, cfg: LedgerConfig):
    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = latest_wins(batch, ["series_id", "slot_utc"], ["ingested_at", "value"]).withColumn(
            "month", local_month(F.col("slot_utc"), cfg)
        )
        price_archive(spark, archive_path).upsert(fresh)

    return merge


def stream_chunks(
    spark: SparkSession, landing: str, archive_path: str, checkpoint: str, cfg: LedgerConfig
) -> StreamingQuery:
    """Merge every landed JSON file once and stop when none is left."""
    landed = spark.readStream.schema(LANDED_SCHEMA).json(landing)
    slots = parse_price_chunks(landed)
    return (
        slots.writeStream.foreachBatch(merge_batch(archive_path, cfg))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
