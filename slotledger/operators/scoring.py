"""Scoring of every forecast that was due, absent ones included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotledger.config import LedgerConfig, ModelSpec
from slotledger.functions import timecols as t
from slotledger.functions.losses import error_columns
from slotledger.models.requests import forecast_requests
from slotledger.operators.bands import KEYS

VECTORS = ("q10", "q50", "q90")


def due_grid(targets: DataFrame, specs: Sequence[ModelSpec], cfg: LedgerConfig) -> DataFrame:
    """Every (model, horizon, target) whose issue day lies in the model's live period."""
    grid = forecast_requests(targets, specs, cfg)
    since = F.coalesce("live_since", F.lit("0001-01-01").cast("date"))
    due = grid.filter(t.model_due(F.col("issue_date"), since, F.col("retired_after")))
    return due.select(*KEYS, "issue_date", "target_date")


def scorable_days(complete: DataFrame, scored: DataFrame, now: Column, cfg: LedgerConfig) -> DataFrame:
    """Days ready to be scored: complete, deadline passed, not scored before."""
    ready = complete.filter(F.col("complete")).select("series_id", F.col("day").alias("target_date"))
    ready = ready.filter(t.deadline_passed(F.col("target_date"), now, cfg))
    return ready.join(scored.select("series_id", "target_date").distinct(), ["series_id", "target_date"], "left_anti")


def pending_days(complete: DataFrame, scored: DataFrame, now: Column, cfg: LedgerConfig) -> DataFrame:
    """Days not scored yet that cannot be scored now."""
    days = complete.select("series_id", F.col("day").alias("target_date"), "complete")
    waiting = days.filter(~(F.col("complete") & t.deadline_passed(F.col("target_date"), now, cfg)))
    return waiting.join(scored.select("series_id", "target_date").distinct(), ["series_id", "target_date"], "left_anti").drop("complete")


def score_slots(due: DataFrame, forecasts: DataFrame, actuals: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """One row per due forecast and slot with its errors.

    ``forecasts`` is the stored table (one row per slot), ``actuals`` is packed by day. The due
    grid and the actuals meet as one row per day before slots are spread, so the only wide join
    is the one with the stored forecasts.
    """
    day = actuals.select("series_id", F.col("day").alias("target_date"), F.col("values").alias("actuals"))
    grid = due.join(day, ["series_id", "target_date"])
    cells = F.arrays_zip(t.day_slots(F.col("target_date"), cfg).alias("slot_utc"), F.col("actuals").alias("actual"))
    slots = grid.select(*KEYS, "issue_date", "target_date", F.inline(cells).alias("slot_utc", "actual"))
    keys = [*KEYS, "issue_date", "target_date"]
    stored = forecasts.select(*keys, "slot_utc", "q10", "q50", "q90", F.lit(True).alias("issued"))
    rows = slots.join(stored, [*keys, "slot_utc"], "left")
    w = Window.partitionBy(*keys)
    gap = F.col("q10").isNull() | F.col("q50").isNull() | F.col("q90").isNull()
    rows = rows.withColumn("any_issued", F.max("issued").over(w)).withColumn("any_gap", F.max(gap).over(w))
    status = (
        F.when(F.col("any_issued").isNull(), "missed")
        .when(F.col("any_gap"), "incomplete")
        .otherwise("scored")
    )
    return _with_errors(rows.withColumn("status", status).drop("issued", "any_issued", "any_gap"))


def score_days(due: DataFrame, banded: DataFrame, actuals: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """One row per due forecast with its slots, actual values and quantiles as arrays of one length.

    Quantiles of a missed forecast are arrays of NULLs.
    """
    day = actuals.select("series_id", F.col("day").alias("target_date"), F.col("values").alias("actual"))
    keys = [*KEYS, "issue_date", "target_date"]
    vectors = banded.select(*keys, "q10", "q50", "q90")
    grid = due.join(vectors, keys, "left").join(day, ["series_id", "target_date"])
    holes = lambda c: F.exists(c, lambda x: x.isNull())
    status = (
        F.when(F.col("q50").isNull(), "missed")
        .when(holes("q10") | holes("q50") | holes("q90"), "incomplete")
        .otherwise("scored")
    )
    empty = F.transform("actual", lambda _: F.lit(None).cast("double"))
    return grid.select(
        *keys, status.alias("status"), t.day_slots(F.col("target_date"), cfg).alias("slots"), "actual",
        *[F.coalesce(q, empty).alias(q) for q in VECTORS],
    )


def pack_scores(scores: DataFrame) -> DataFrame:
    """Stored score rows as ``score_days`` gives them; a row holds the slots of one day."""
    keys = [*KEYS, "issue_date", "target_date", "status"]
    cells = F.sort_array(F.collect_list(F.struct("slot_utc", "actual", *VECTORS)))
    packed = scores.groupBy(*keys).agg(cells.alias("c"))
    return packed.select(*keys, F.col("c.slot_utc").alias("slots"), *[F.col(f"c.{n}").alias(n) for n in ("actual", *VECTORS)])


def slots_of(scored_days: DataFrame, *more: str) -> DataFrame:
    """Score rows of packed days, spread without an exchange; ``more`` names further arrays to spread along."""
    cells = F.arrays_zip("slots", "actual", *VECTORS, *more)
    kept = [*KEYS, "issue_date", "target_date", "status"]
    others = [c for c in scored_days.columns if c not in {*kept, "slots", "actual", *VECTORS, *more}]
    rows = scored_days.select(*kept, *others, F.inline(cells).alias("slot_utc", "actual", *VECTORS, *more))
    return _with_errors(rows, *others, *more)


def score_vectors(due: DataFrame, banded: DataFrame, actuals: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """Same rows as ``score_slots`` for forecasts still held as vectors (the backtest path).

    Everything joins as one row per forecast day; slots are spread last, without an exchange.
    """
    return slots_of(score_days(due, banded, actuals, cfg))


def _with_errors(rows: DataFrame, *others: str) -> DataFrame:
    errors = error_columns(F.col("actual"), F.col("q10"), F.col("q50"), F.col("q90"))
    return rows.select(
        *KEYS, "issue_date", "target_date", "slot_utc", "status", "actual", *VECTORS,
        *[c.alias(name) for name, c in errors.items()], *others,
    )
