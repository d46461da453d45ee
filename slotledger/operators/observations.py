"""Observations by slot: revisions, packed days, gaps and completeness.

Row form is ``(series_id, slot_utc, value)``. Packed form holds one local day per row,
``(series_id, day, n_slots, n_present, values)`` with ``values`` in slot order and NULL where a
slot is missing; it is bounded by the slots of one day and carries the keys once per day, which
keeps every later exchange small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.config import LedgerConfig
from slotledger.functions import timecols as t


def latest_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key as a partial+final aggregate, so copies collapse before the exchange."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("best")
    newest = [F.max(F.struct(*order)).alias("newest")]
    out = df.groupBy(*keys).agg(best, *newest)
    return out.select(
        *keys,
        *[F.col(f"best.{c}").alias(c) for c in rest],
        *[F.col(f"newest.{c}").alias(c) for c in order],
    )


def latest_wins_merge(archive: DataFrame, fresh: DataFrame) -> DataFrame:
    """Archive and fresh observations in one series; the most recently ingested value wins."""
    both = archive.unionByName(fresh).filter(F.col("value").isNotNull())
    return latest_wins(both, ["series_id", "slot_utc"], ["ingested_at", "value"])


def range_scan(obs: DataFrame, start: Column, end: Column) -> DataFrame:
    """Known values in ``[start, end)``, duplicates resolved; prunes by the month partition."""
    hit = obs.filter((F.col("slot_utc") >= start) & (F.col("slot_utc") < end))
    if "month" in obs.columns:  # local months can start up to a day before the UTC month
        lo, hi = F.date_format(F.date_sub(start, 1), "yyyy-MM"), F.date_format(F.date_add(end, 1), "yyyy-MM")
        hit = hit.filter(F.col("month").between(lo, hi))
    hit = hit.filter(F.col("value").isNotNull())
    return latest_wins(hit, ["series_id", "slot_utc"], ["ingested_at", "value"])


def day_spine(bounds: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """``(series_id, day, n_slots)`` for every local day between ``first_day`` and ``last_day``."""
    days = bounds.select(
        "series_id", F.explode(F.sequence("first_day", "last_day")).alias("day")
    )
    return days.withColumn("n_slots", t.slots_in_day(F.col("day"), cfg))


def day_bounds_of(obs: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """First and last local day of each series."""
    first_last = obs.groupBy("series_id").agg(
        F.min("slot_utc").alias("lo"), F.max("slot_utc").alias("hi")
    )
    return first_last.select(
        "series_id",
        t.local_date(F.col("lo"), cfg.tz).alias("first_day"),
        t.local_date(F.col("hi"), cfg.tz).alias("last_day"),
    )


def slot_spine(spine: DataFrame, cfg: LedgerConfig) -> DataFrame:
    return spine.select(
        "series_id", "day", F.explode(t.day_slots(F.col("day"), cfg)).alias("slot_utc")
    )


def pack_days(obs: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """One row per series and local day; input must hold one row per slot."""
    day = t.local_date(F.col("slot_utc"), cfg.tz)
    rows = obs.filter(F.col("value").isNotNull()).select(
        "series_id", day.alias("day"), "slot_utc", "value"
    )
    packed = rows.groupBy("series_id", "day").agg(
        F.sort_array(
            F.collect_list(
                F.struct(t.slot_index(F.col("slot_utc"), F.col("day"), cfg).alias("i"), F.col("value"))
            )
        ).alias("filled")
    )
    sized = packed.select(
        "series_id",
        "day",
        t.slots_in_day(F.col("day"), cfg).alias("n_slots"),
        F.size("filled").alias("n_present"),
        "filled",
    )
    by_slot = F.map_from_entries("filled")
    values = F.when(
        F.col("n_present") == F.col("n_slots"), F.transform("filled", lambda e: e["value"])
    ).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("n_slots") - 1), lambda i: F.try_element_at(by_slot, i)
        )
    )
    return sized.select("series_id", "day", "n_slots", "n_present", values.alias("values"))


def unpack_days(days: DataFrame, cfg: LedgerConfig, value: str = "value") -> DataFrame:
    """Back to one row per slot, missing slots as NULL."""
    slots = F.arrays_zip(
        t.day_slots(F.col("day"), cfg).alias("slot_utc"), F.col("values").alias(value)
    )
    return days.select("series_id", "day", F.inline(slots).alias("slot_utc", value))


def spread_over_spine(days: DataFrame, spine: DataFrame) -> DataFrame:
    """Every day of the spine; days without any observation get an all-NULL vector."""
    joined = spine.join(days.drop("n_slots"), ["series_id", "day"], "left")
    empty = F.transform(
        F.sequence(F.lit(1), F.col("n_slots")), lambda _: F.lit(None).cast("double")
    )
    return joined.select(
        "series_id",
        "day",
        "n_slots",
        F.coalesce("n_present", F.lit(0)).alias("n_present"),
        F.coalesce("values", empty).alias("values"),
    )


def completeness(days: DataFrame, spine: DataFrame) -> DataFrame:
    """Per day of the spine whether every slot has a value."""
    counted = days.select("series_id", "day", "n_present")
    joined = spine.join(counted, ["series_id", "day"], "left")
    n = F.coalesce("n_present", F.lit(0))
    return joined.select(
        "series_id", "day", "n_slots", n.alias("n_present"), (n == F.col("n_slots")).alias("complete")
    )


def incomplete_days(days: DataFrame, spine: DataFrame) -> DataFrame:
    return completeness(days, spine).filter(~F.col("complete")).drop("complete")


def fill_from_fallback(days: DataFrame, fallback: DataFrame, spine: DataFrame) -> DataFrame:
    """Fill only the missing slots from a second source; a known value is never replaced.

    Returns packed days with ``filled`` (1 where the fallback supplied the slot) and ``n_filled``.
    Complete days never meet the fallback: only days with a gap take part in that join.
    """
    full = spread_over_spine(days, spine)
    gaps = full.filter(F.col("n_present") < F.col("n_slots"))
    second = fallback.select("series_id", "day", F.col("values").alias("second"))
    joined = gaps.join(second, ["series_id", "day"], "left")
    # a day the fallback does not know keeps its gaps
    alt = F.coalesce("second", F.transform("values", lambda _: F.lit(None).cast("double")))
    repaired = joined.select(
        "series_id",
        "day",
        "n_slots",
        F.zip_with("values", alt, lambda a, b: F.coalesce(a, b)).alias("values"),
        F.zip_with(
            "values", alt, lambda a, b: (a.isNull() & b.isNotNull()).cast("int")
        ).alias("filled"),
    )
    untouched = full.filter(F.col("n_present") == F.col("n_slots")).select(
        "series_id", "day", "n_slots", "values", F.transform("values", lambda _: F.lit(0)).alias("filled")
    )
    out = untouched.unionByName(repaired)
    return out.withColumn("n_present", F.size(F.filter("values", lambda x: x.isNotNull()))).withColumn(
        "n_filled", F.aggregate("filled", F.lit(0), lambda a, x: a + x)
    )


def fallback_log(filled: DataFrame, fetched_at: Column, source: str) -> DataFrame:
    """Which local days were completed from the fallback, and by how many slots."""
    return filled.filter(F.col("n_filled") > 0).select(
        "series_id",
        fetched_at.alias("fetched_at_utc"),
        F.col("day").alias("delivery_date_local"),
        F.col("n_filled").cast("bigint").alias("slots_filled"),
        F.lit(source).alias("source"),
    )
