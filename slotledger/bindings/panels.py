"""Series derived from the given parquet tables.

``events`` gives one series per event type (quarter-hours or hours), ``lineitem`` one hourly
series per line status over several years, which brings every switch of the local clock. Values
are whole numbers held as doubles, so sums do not depend on the order of addition.

Packed days are a stored table, partitioned by month: the raw table is scanned and aggregated once a session, plans that read days
several times (profiles, actuals, due days) or only some of their columns or months open just those.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotledger.config import NAIVE_SPECS, LedgerConfig
from slotledger.operators import observations as o
from slotledger.session import shared_folder

QUARTER = LedgerConfig(near_tolerance=500.0)
HOURLY = LedgerConfig(slot_minutes=60, near_tolerance=500.0)

# Thirty days of events allow only short error windows.
SHORT_SPECS = tuple(
    replace(s, error_days=6, min_error_days=4, live_since=date(2024, 1, 10)) for s in NAIVE_SPECS
)

# Event values are shifted by this many hundredths so that low slots turn negative.
EVENT_SHIFT = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _floor_slot(ts, cfg: LedgerConfig):
    seconds = F.unix_seconds(ts)
    return F.timestamp_seconds(seconds - seconds % cfg.slot_seconds)


def event_slots(spark: SparkSession, sf_dir: str, cfg: LedgerConfig) -> DataFrame:
    """``(series_id, slot_utc, value)`` with one row per slot that saw an event."""
    ev = read(spark, sf_dir, "events").select(
        F.col("event_type").alias("series_id"),
        _floor_slot(F.col("ts").cast("timestamp"), cfg).alias("slot_utc"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )
    return ev.groupBy("series_id", "slot_utc").agg(
        (F.sum("cents") - EVENT_SHIFT).cast("double").alias("value")
    )


_STORED: dict[tuple, str] = {}
DAY_SCHEMA = "series_id string, day date, n_slots int, n_present int, values array<double>, month string"


def day_table(spark: SparkSession, sf_dir: str, table: str, name: str, make) -> DataFrame:
    """Packed days with their ``month`` as a stored table; written at the first use by a session and for the files at hand."""
    key = (spark.sparkContext.applicationId, name, *sorted(read(spark, sf_dir, table).inputFiles()))
    if key not in _STORED:
        path = shared_folder(spark, "packed-days")
        days = make().select("series_id", "day", "n_slots", "n_present", "values").withColumn("month", F.date_format("day", "yyyy-MM"))
        days.repartition("month", "series_id").write.partitionBy("month").parquet(path)
        _STORED[key] = path
    return spark.read.schema(DAY_SCHEMA).parquet(_STORED[key])


def between(table: DataFrame, first: date, last: date) -> DataFrame:
    """Days of a stored table from ``first`` to ``last``; other months are not opened."""
    months = F.col("month").between(f"{first:%Y-%m}", f"{last:%Y-%m}")
    return table.filter(months & F.col("day").between(F.lit(first), F.lit(last))).drop("month")


def event_day_table(spark: SparkSession, sf_dir: str, cfg: LedgerConfig = QUARTER, fill: bool = True) -> DataFrame:
    def make() -> DataFrame:
        packed = o.pack_days(event_slots(spark, sf_dir, cfg), cfg)
        return zero_filled(packed, -EVENT_SHIFT) if fill else packed

    return day_table(spark, sf_dir, "events", f"events-{cfg.slot_minutes}-{fill}", make)


def line_day_table(spark: SparkSession, sf_dir: str, fill: bool = True) -> DataFrame:
    def make() -> DataFrame:
        packed = o.pack_days(line_slots(spark, sf_dir), HOURLY)
        return zero_filled(packed, 0.0) if fill else packed

    return day_table(spark, sf_dir, "lineitem", f"lines-{fill}", make)


def event_days(spark: SparkSession, sf_dir: str, cfg: LedgerConfig = QUARTER, fill: bool = True) -> DataFrame:
    """Packed days of the event series; with ``fill`` a slot without events counts as zero."""
    return event_day_table(spark, sf_dir, cfg, fill).drop("month")


def zero_filled(packed: DataFrame, zero: float) -> DataFrame:
    filled = F.transform("values", lambda x: F.coalesce(x, F.lit(float(zero))))
    return packed.select("series_id", "day", "n_slots", F.col("n_slots").alias("n_present"), filled.alias("values"))


def line_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly line values by status; the hour of the day comes from the order and line number."""
    li = read(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("series_id"),
        F.timestamp_seconds(
            F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
            + ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 5) % 24) * 3600
        ).alias("slot_utc"),
        F.round(F.col("l_extendedprice")).cast("bigint").alias("amount"),
    )
    return li.groupBy("series_id", "slot_utc").agg(F.sum("amount").cast("double").alias("value"))


def line_days(spark: SparkSession, sf_dir: str, fill: bool = True) -> DataFrame:
    return line_day_table(spark, sf_dir, fill).drop("month")
