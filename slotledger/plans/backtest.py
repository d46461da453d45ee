"""Rolling-origin replay: the live plan with the issue date as a column instead of a loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotledger.config import NAIVE_SPECS, LedgerConfig, ModelSpec
from slotledger.models import boosting, lasso
from slotledger.models.naive import naive_points
from slotledger.operators import bands, scoring, windows
from slotledger.session import materialize, spread


def targets_of(days: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """All observed days plus the days up to the longest horizon behind the last one."""
    bounds = days.groupBy("series_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    targets = bounds.select(
        "series_id",
        F.explode(F.sequence("lo", F.date_add("hi", max(cfg.horizons)))).alias("target_date"),
    )
    return spread(targets, "series_id", "target_date")


def naive_errors(days: DataFrame, cfg: LedgerConfig, specs: Sequence[ModelSpec] = NAIVE_SPECS) -> DataFrame:
    """Point vectors of every rule and target with their errors where the target is known."""
    return bands.with_errors(naive_points(days, targets_of(days, cfg), cfg, specs), days, cfg)


def naive_bands(days: DataFrame, cfg: LedgerConfig, specs: Sequence[ModelSpec] = NAIVE_SPECS) -> DataFrame:
    """Banded vectors of every rule for every issue date that has enough past errors."""
    quantiles = bands.error_quantiles(naive_errors(days, cfg, specs), cfg, [s.error_days for s in specs])
    return bands.apply_bands(quantiles, cfg)


def naive_windows(days: DataFrame, cfg: LedgerConfig, specs: Sequence[ModelSpec] = NAIVE_SPECS) -> DataFrame:
    curves = windows.scenario_curves(naive_errors(days, cfg, specs), cfg, [s.error_days for s in specs])
    return windows.recommend_windows(curves, cfg)


def backtest_due(days: DataFrame, cfg: LedgerConfig, specs: Sequence[ModelSpec]) -> DataFrame:
    """Every model and horizon is due on every observed day."""
    return scoring.due_grid(days.select("series_id", F.col("day").alias("target_date")), specs, cfg)


def naive_scored_days(days: DataFrame, cfg: LedgerConfig, specs: Sequence[ModelSpec] = NAIVE_SPECS) -> DataFrame:
    """Packed scores of all rules; days with too little history stay in the result as missed."""
    return scoring.score_days(backtest_due(days, cfg, specs), naive_bands(days, cfg, specs), days, cfg)


def naive_backtest(days: DataFrame, cfg: LedgerConfig, specs: Sequence[ModelSpec] = NAIVE_SPECS) -> DataFrame:
    """The same as score rows, one per slot."""
    return scoring.slots_of(naive_scored_days(days, cfg, specs))


def learned_bands(
    days: DataFrame, covariates: DataFrame, cfg: LedgerConfig, every: int = lasso.REFIT_DAYS, size: boosting.BoostingSize = boosting.BoostingSize(),
    specs: tuple[ModelSpec, ModelSpec] = (lasso.LASSO_SPEC, boosting.BOOST_SPEC), windows: Sequence[int] = lasso.WINDOWS,
) -> DataFrame:
    """Banded vectors of the two learned models for every target of the panel, refit on the anchor grid as a live run would be."""
    asked = materialize(targets_of(days, cfg))
    linear, boosted = specs
    points = materialize(lasso.lasso_replay(days, asked, cfg, every, windows, spec=linear))
    native = materialize(boosting.boosted_points(days, covariates, asked, cfg, every, size, boosted))
    banded = bands.empirical_bands(points, days, cfg, [linear.error_days])
    calibrated = bands.conformal_bands(native, days, cfg, [boosted.error_days])
    return banded.unionByName(calibrated.select(*banded.columns))


def full_backtest(days: DataFrame, learned: DataFrame, cfg: LedgerConfig, naive: Sequence[ModelSpec], learned_specs: Sequence[ModelSpec]) -> DataFrame:
    """Score rows of the rules and the learned models over every observed day; what a model could not forecast stays as missed."""
    due = backtest_due(days, cfg, [*naive, *learned_specs])
    banded = naive_bands(days, cfg, naive)
    return scoring.score_vectors(due, banded.unionByName(learned.select(*banded.columns)), days, cfg)


def labelled_summary(cube: DataFrame, scores: DataFrame, kind: str) -> DataFrame:
    """Metrics with their kind and period, kept apart from rows of another kind."""
    period = scores.groupBy("series_id").agg(
        F.min("target_date").alias("first_target"), F.max("target_date").alias("last_target")
    )
    return cube.join(period, "series_id").withColumn("kind", F.lit(kind))


def latest_run(runs: DataFrame) -> DataFrame:
    """Newest run of each series that has a summary; run ids sort by period."""
    return runs.filter("has_summary").groupBy("series_id").agg(F.max("run_id").alias("run_id"))
