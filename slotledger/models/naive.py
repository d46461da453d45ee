"""Rules of thumb: copy the profile of one known past day onto the target day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.config import NAIVE_SPECS, LedgerConfig, ModelSpec
from slotledger.models.requests import forecast_requests
from slotledger.operators.shaping import profile_map


def source_day(rule: Column, issue: Column, target: Column) -> Column:
    """The day whose profile a rule copies; NULL for an unknown rule."""
    week_before = F.date_sub(target, 7)
    similar = F.when(F.weekday(target).isin(0, 5, 6), week_before).otherwise(
        F.least(F.date_sub(target, 1), issue)
    )
    return (
        F.when(rule == "last_day", issue)
        .when(rule == "weekly", week_before)
        .when(rule == "similar_day", similar)
    )


def naive_points(
    days: DataFrame,
    targets: DataFrame,
    cfg: LedgerConfig,
    specs: Sequence[ModelSpec] = NAIVE_SPECS,
) -> DataFrame:
    """Point vectors of every rule for every target; a source after the issue day is refused."""
    asked = forecast_requests(targets, specs, cfg).withColumn(
        "source_day", source_day(F.col("rule"), F.col("issue_date"), F.col("target_date"))
    )
    lawful = asked.filter(F.col("source_day") <= F.col("issue_date"))
    return profile_map(lawful, days, cfg).drop("rule")
