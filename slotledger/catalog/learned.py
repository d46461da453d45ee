"""Learned models on the line panel: forecasts of every target with enough history, and the replay of all five models.

A session fits the models of a table once; the queries of this module read the stored points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotledger.bindings import panels as p
from slotledger.catalog.base import query, r, utc
from slotledger.catalog.shaping import line_covariates
from slotledger.config import NAIVE_SPECS
from slotledger.models import boosting, lasso
from slotledger.operators import bands, scoring, summary, windows
from slotledger.plans import backtest as bt
from slotledger.session import materialize
from slotledger.sources import feeds

H = p.HOURLY
LEARNED = (lasso.LASSO_SPEC, boosting.BOOST_SPEC)
ALL_SPECS = (*NAIVE_SPECS, *LEARNED)
_STORED: dict[tuple[str, str, str], DataFrame] = {}


def _once(name: str, spark: SparkSession, sf: str, make) -> DataFrame:
    """The frame of this name, computed and stored at its first use in a session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        _STORED[key] = materialize(make())
    return _STORED[key]


def line_days(spark, sf):
    return _once("days", spark, sf, lambda: p.line_days(spark, sf))


def asked(spark, sf):
    return _once("asked", spark, sf, lambda: bt.targets_of(line_days(spark, sf), H))


def lasso_points(spark, sf):
    return _once("lasso", spark, sf, lambda: lasso.lasso_replay(line_days(spark, sf), asked(spark, sf), H))


def boosted_points(spark, sf):
    covariates = line_covariates(spark, sf).withColumn("available_at_utc", feeds.available_at(H))
    return _once("boosting", spark, sf, lambda: boosting.boosted_points(line_days(spark, sf), covariates, asked(spark, sf), H))


def lasso_bands(spark, sf):
    return bands.empirical_bands(lasso_points(spark, sf), line_days(spark, sf), H, [lasso.LASSO_SPEC.error_days])


def boosted_bands(spark, sf):
    return bands.conformal_bands(boosted_points(spark, sf), line_days(spark, sf), H, [boosting.BOOST_SPEC.error_days])


def replay(spark, sf):
    """Score rows of the three rules and the two learned models."""
    def make():
        banded = lasso_bands(spark, sf)
        both = banded.unionByName(boosted_bands(spark, sf).select(*banded.columns))
        return bt.full_backtest(line_days(spark, sf), both, H, NAIVE_SPECS, LEARNED)

    return _once("scores", spark, sf, make)


def _rows(banded):
    out = bands.forecast_rows(banded, H)
    return out.select("series_id", "model", "horizon_days", "issue_date", "target_date", utc("slot_utc").alias("slot"), r("q10", 3).alias("q10"), r("q50", 3).alias("q50"), r("q90", 3).alias("q90"))


@query("lasso_autoregression")
def lasso_autoregression(spark, sf):
    """Every target with enough history, by the fit of the newest anchor before its issue, with the model's own error windows."""
    return _rows(lasso_bands(spark, sf))


@query("pooled_quantile_regression")
def pooled_quantile_regression(spark, sf):
    """Boosted quantiles of every target with enough history, refit on the anchor grid, bands calibrated conformally over 60 days."""
    return _rows(boosted_bands(spark, sf))


@query("learned_backtest")
def learned_backtest(spark, sf):
    """Daily scores of all five models over every observed day."""
    daily = summary.daily_scores(replay(spark, sf))
    return daily.select(*daily.columns)


@query("learned_metric_cube")
def learned_metric_cube(spark, sf):
    return summary.metric_cube(scoring.pack_scores(replay(spark, sf)), H)


@query("learned_significance")
def learned_significance(spark, sf):
    return summary.diebold_mariano(summary.daily_scores(replay(spark, sf)), H)


@query("learned_window_summary")
def learned_window_summary(spark, sf):
    """Cheapest windows of all five models: recommended from their past errors, judged by the actual values."""
    days = line_days(spark, sf)
    errors = bt.naive_errors(days, H, NAIVE_SPECS).drop("source_day", "live_since", "retired_after")
    for points in (lasso_points(spark, sf), boosted_points(spark, sf)):
        errors = errors.unionByName(bands.with_errors(points, days, H).select(*errors.columns))
    curves = windows.scenario_curves(errors, H, sorted({s.error_days for s in ALL_SPECS}))
    stated = windows.recommend_windows(curves, H)
    judged = windows.realized_windows(bt.backtest_due(days, H, ALL_SPECS), stated, days, H)
    return summary.window_summary(judged, H)
