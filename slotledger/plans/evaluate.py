"""Scoring of everything that became due, and the tables that are rolled up from all scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.config import NAIVE_SPECS, LedgerConfig, ModelSpec
from slotledger.operators import observations as o
from slotledger.operators import scoring, summary, windows


def due_now(
    days: DataFrame, scored: DataFrame, now: Column, cfg: LedgerConfig, specs: Sequence[ModelSpec]
) -> DataFrame:
    """Due (model, horizon, target) rows of all days that can be scored and were not yet."""
    bounds = days.groupBy("series_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    complete = o.completeness(days, o.day_spine(bounds, cfg))
    return scoring.due_grid(scoring.scorable_days(complete, scored, now, cfg), specs, cfg)


def new_scores(
    days: DataFrame, forecasts: DataFrame, scored: DataFrame, now: Column, cfg: LedgerConfig,
    specs: Sequence[ModelSpec] = NAIVE_SPECS,
) -> DataFrame:
    """Score rows to append; running it again after appending yields nothing."""
    due = due_now(days, scored, now, cfg, specs)
    return scoring.score_slots(due, forecasts, days, cfg).withColumn("scored_at_utc", now)


def new_window_scores(
    days: DataFrame, stated: DataFrame, scored: DataFrame, now: Column, cfg: LedgerConfig,
    specs: Sequence[ModelSpec] = NAIVE_SPECS,
) -> DataFrame:
    due = due_now(days, scored, now, cfg, specs)
    return windows.realized_windows(due, stated, days, cfg).withColumn("scored_at_utc", now)


def summary_tables(scores: DataFrame, window_scores: DataFrame, cfg: LedgerConfig) -> dict[str, DataFrame]:
    """The regenerated summary: metrics, tests, missed forecasts and window outcomes."""
    daily = summary.daily_scores(scores)
    return {
        "metrics": summary.metric_cube(scoring.pack_scores(scores), cfg),
        "dm_tests": summary.diebold_mariano(daily, cfg),
        "missed": summary.missed_list(scores),
        "cheapest": summary.window_summary(window_scores, cfg),
        "spike_thresholds": summary.spike_thresholds(summary.scored_slots(scores), cfg),
    }
