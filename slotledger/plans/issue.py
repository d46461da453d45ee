"""The live run: forecasts for the next days of an issue date, from what is known on that date."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.config import NAIVE_SPECS, LedgerConfig, ModelSpec
from slotledger.functions import timecols as t
from slotledger.models.naive import naive_points
from slotledger.operators import asof, bands, windows
from slotledger.session import spread
from slotledger.sources import ledger


def _targets_back(issues: DataFrame, cfg: LedgerConfig, error_days: int) -> DataFrame:
    """Targets of the issue itself and the past targets its bands need."""
    span = F.sequence(F.date_sub("issue_date", error_days - 1), F.date_add("issue_date", max(cfg.horizons)))
    targets = issues.select("series_id", F.explode(span).alias("target_date")).distinct()
    return spread(targets, "series_id", "target_date")


def look_back(specs: Sequence[ModelSpec]) -> timedelta:
    """How far before an issue the rules read: the oldest error day, and the week before it that its forecast copied."""
    return timedelta(days=max(s.error_days for s in specs) - 1 + 7 + 1)


def issue_errors(
    days: DataFrame, issues: DataFrame, cfg: LedgerConfig, specs: Sequence[ModelSpec]
) -> DataFrame:
    """Points and past errors needed for the given issues, from days up to each issue day only."""
    longest = max(s.error_days for s in specs)
    last = issues.groupBy("series_id").agg(F.max("issue_date").alias("last_issue"))
    known = days.join(last, "series_id").filter(F.col("day") <= F.col("last_issue")).drop("last_issue")
    return bands.with_errors(naive_points(known, _targets_back(issues, cfg, longest), cfg, specs), known, cfg)


def issue_naive(
    days: DataFrame, issues: DataFrame, cfg: LedgerConfig, specs: Sequence[ModelSpec] = NAIVE_SPECS
) -> DataFrame:
    """Forecast rows of the given ``(series_id, issue_date)``; violations of the quantile order drop
    out here and show up as missed when scored."""
    errors = issue_errors(days, issues, cfg, specs)
    quantiles = bands.error_quantiles(errors, cfg, [s.error_days for s in specs])
    banded = bands.apply_bands(quantiles, cfg).join(issues, ["series_id", "issue_date"], "left_semi")
    return bands.forecast_rows(banded.filter(sound()), cfg)


def sound() -> Column:
    """No missing value and no crossed quantiles in a banded vector."""
    cells = F.arrays_zip("q10", "q50", "q90")
    return F.forall(
        cells, lambda c: F.coalesce((c["q10"] <= c["q50"]) & (c["q50"] <= c["q90"]), F.lit(False))
    )


def issue_windows(
    days: DataFrame, issues: DataFrame, cfg: LedgerConfig, specs: Sequence[ModelSpec] = NAIVE_SPECS
) -> DataFrame:
    errors = issue_errors(days, issues, cfg, specs)
    curves = windows.scenario_curves(errors, cfg, [s.error_days for s in specs])
    asked = curves.join(issues, ["series_id", "issue_date"], "left_semi")
    return windows.recommend_windows(asked, cfg)


def run_issue(
    obs_days: DataFrame,
    fresh: DataFrame,
    issues: DataFrame,
    existing: DataFrame,
    issued_at: Column,
    cfg: LedgerConfig,
    specs: Sequence[ModelSpec] = NAIVE_SPECS,
) -> DataFrame:
    """Stored forecast rows of one run.

    Outside the issue window nothing is issued, an issue whose next day is already visible is
    refused, and forecasts the ledger already holds are not made again.
    """
    open_now = issues.filter((t.local_date(issued_at, cfg.tz) == F.col("issue_date")) & t.in_issue_window(issued_at, cfg))
    refused = asof.already_published(open_now, fresh, cfg)
    allowed = open_now.join(refused.select("series_id", "issue_date"), ["series_id", "issue_date"], "left_anti")
    rows = issue_naive(obs_days, allowed, cfg, specs)
    new = rows.join(existing.select(*ledger.MODEL_KEYS).distinct(), ledger.MODEL_KEYS, "left_anti")
    return ledger.forecast_table(new, issued_at, cfg)
