"""Lasso autoregression: a penalised linear model pooled over series and hours of the day.

A fit takes every complete hour of a training window that ends with the anchor day, for all series at once, with Spark ML's
``LinearRegression``; windows of several lengths are fitted and their forecasts averaged. The penalty is the one of a short list
with the smallest Akaike criterion. An anchor serves every later issue until the next refit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotledger.config import LedgerConfig, ModelSpec
from slotledger.functions.arrays import array_mean, field_of
from slotledger.models.refits import anchors_between, hourly_tasks, issue_span, side_by_side
from slotledger.operators import shaping
from slotledger.session import materialize

LASSO_SPEC = ModelSpec("lasso_ar", error_days=60, min_error_days=20)
WINDOWS = (182, 364, 728)
PENALTIES = (0.1, 0.01, 0.001)
MIN_SHARE = 0.9
#: Days that one fit serves.
REFIT_DAYS = 364
HOUR_KEYS = ("series_id", "horizon_days", "target_date", "hour")


def hourly_design(matrix: DataFrame, horizon: int) -> DataFrame:
    """One row per target hour: ``levels`` (scaled before a fit), ``marks`` (dummies) and the target ``y``.

    Levels are the four lagged values of the same hour, the means of those days, and the last hour known.
    Rows with an unknown level are left out; ``y`` is NULL for days to come.
    """
    wide = shaping.lag_features(matrix, horizon).filter(~F.exists("x_lags", lambda v: v.isNull()))
    days = [F.slice("x_lags", 24 * k + 1, 24) for k in range(4)]
    hour = F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")
    rows = wide.select("series_id", "horizon_days", "target_date", "x_lags", "x_calendar", F.col("y").alias("hours"), *[array_mean(d).alias(f"mean{k}") for k, d in enumerate(days)], hour)
    levels = [*[F.get("x_lags", F.col("hour") + 24 * k) for k in range(4)], *[F.col(f"mean{k}") for k in range(4)], F.get("x_lags", F.lit(23))]
    dummies = F.transform(F.sequence(F.lit(0), F.lit(22)), lambda k: (k == F.col("hour")).cast("double"))
    marks = F.concat(F.transform("x_calendar", lambda v: v.cast("double")), dummies)
    return rows.select(*HOUR_KEYS, F.array(*levels).alias("levels"), marks.alias("marks"), F.get("hours", F.col("hour")).alias("y"))


def training_rows(rows: DataFrame, anchor: date, window: int) -> DataFrame:
    """Hours of the window's days up to the anchor, of series that have enough of its days."""
    target = F.col("target_date")
    inside = rows.filter((target <= F.lit(anchor)) & (target > F.date_sub(F.lit(anchor), window)) & F.col("y").isNotNull())
    enough = inside.groupBy("series_id").agg(F.count_distinct("target_date").alias("n")).filter(F.col("n") >= MIN_SHARE * window)
    return inside.join(enough.select("series_id"), "series_id", "left_semi")


def window_scale(train: DataFrame) -> DataFrame:
    """Median and spread (MAD / 0.6745) of each series in the window, from sketches of bounded memory; a flat series scales by one."""
    middle = train.groupBy("series_id").agg(F.percentile_approx("y", 0.5, 10000).alias("center"))
    away = F.percentile_approx(F.abs(F.col("y") - F.col("center")), 0.5, 10000) / 0.6745
    spread = train.select("series_id", "y").join(middle, "series_id").groupBy("series_id", "center").agg(away.alias("mad"))
    return spread.select("series_id", "center", F.when(F.col("mad") > 1e-9, F.col("mad")).otherwise(1.0).alias("scale"))


def scaled(rows: DataFrame, scale: DataFrame) -> DataFrame:
    """Features and label on the asinh of robustly scaled values; series without a scale drop out."""
    small = lambda v: F.asinh((v - F.col("center")) / F.col("scale"))
    features = array_to_vector(F.concat(F.transform("levels", small), "marks"))
    return rows.join(scale, "series_id").withColumns({"features": features, "label": small(F.col("y"))})


def best_fit(train: DataFrame, penalties: Sequence[float] = PENALTIES):
    """The model of the penalty with the smallest Akaike criterion; the larger penalty on ties."""
    best, lowest = None, math.inf
    for penalty in sorted(penalties, reverse=True):
        model = LinearRegression(elasticNetParam=1.0, regParam=penalty).fit(train)
        n, mse = model.summary.numInstances, max(model.summary.meanSquaredError, 1e-300)
        aic = n * math.log(mse) + 2 * model.coefficients.numNonzeros()
        if aic < lowest:
            best, lowest = model, aic
    return best


def window_values(rows: DataFrame, ask: DataFrame, anchor: date, window: int, penalties: Sequence[float], tasks: int) -> DataFrame | None:
    """Forecasts of the asked hours by the fit of one window, stored; none where no series has enough of its days.

    They are stored because every task of a plan over all fits would send the counters of each of them to the driver.
    """
    train = training_rows(rows, anchor, window)
    scale = materialize(window_scale(train).repartition(tasks, "series_id"))
    fitted = materialize(scaled(train, scale).select("features", "label").repartition(tasks))
    if fitted.isEmpty():
        return None
    predicted = best_fit(fitted, penalties).transform(scaled(ask, scale))
    value = F.sinh("prediction") * F.col("scale") + F.col("center")
    return materialize(predicted.select(*HOUR_KEYS, value.alias("value")).repartition(tasks, *HOUR_KEYS[:3]))


def lasso_hourly(
    matrix: DataFrame, asked: DataFrame, cfg: LedgerConfig, anchors: Sequence[date], every: int | None = None, windows: Sequence[int] = WINDOWS,
    penalties: Sequence[float] = PENALTIES,
) -> DataFrame:
    """Hourly forecasts of the asked ``(series_id, target_date)``: each anchor serves the issues from its day on, for ``every`` days if given.

    Fits of different anchors, horizons and windows are independent jobs and run side by side.
    """
    tasks = hourly_tasks(matrix)
    targets = materialize(asked.select("series_id", "target_date").distinct().repartition(tasks, "series_id", "target_date"))
    design = lambda h: materialize(hourly_design(matrix, h).repartition(tasks, "series_id", "target_date"))
    designs = dict(zip(cfg.horizons, side_by_side(design, [(h,) for h in cfg.horizons]), strict=True))

    def values(h: int, anchor: date, window: int) -> DataFrame | None:
        issue = F.date_sub("target_date", h)
        served = issue >= F.lit(anchor)
        if every is not None:
            served = served & (issue < F.date_add(F.lit(anchor), every))
        ask = designs[h].join(targets, ["series_id", "target_date"], "left_semi").filter(served)
        return window_values(designs[h], ask, anchor, window, penalties, tasks)

    jobs = [(h, anchor, window) for h in cfg.horizons for anchor in anchors for window in windows]
    parts = [p for p in side_by_side(values, jobs) if p is not None]
    if not parts:  # no window has enough training days: no forecast
        empty = "series_id string, horizon_days int, target_date date, issue_date date, hourly array<double>"
        return matrix.sparkSession.createDataFrame([], empty)
    hourly = reduce(DataFrame.unionByName, parts).groupBy(*HOUR_KEYS).agg(F.avg("value").alias("value"))
    packed = hourly.groupBy(*HOUR_KEYS[:3]).agg(F.sort_array(F.collect_list(F.struct("hour", "value"))).alias("cells"))
    return packed.filter(F.size("cells") == 24).select(
        *HOUR_KEYS[:3], F.date_sub("target_date", F.col("horizon_days")).alias("issue_date"), field_of("cells", "value").alias("hourly")
    )


def lasso_replay(
    days: DataFrame, asked: DataFrame, cfg: LedgerConfig, every: int = REFIT_DAYS, windows: Sequence[int] = WINDOWS,
    penalties: Sequence[float] = PENALTIES, spec: ModelSpec = LASSO_SPEC,
) -> DataFrame:
    """Point vectors of all asked targets, each by the fit of the newest anchor at or before its issue."""
    issues = asked.select(F.explode(F.array(*[F.date_sub("target_date", h) for h in cfg.horizons])).alias("issue_date"))
    span = issue_span(issues)
    anchors = anchors_between(*span, every) if span else []
    return laid_out(lasso_hourly(shaping.hourly_matrix(days, cfg), asked, cfg, anchors, every, windows, penalties), days, cfg, spec)


def lasso_points(
    days: DataFrame, asked: DataFrame, cfg: LedgerConfig, anchor: date, windows: Sequence[int] = WINDOWS,
    penalties: Sequence[float] = PENALTIES, spec: ModelSpec = LASSO_SPEC,
) -> DataFrame:
    """Point vectors of one anchor's fit, in the layout every band operator takes."""
    return laid_out(lasso_hourly(shaping.hourly_matrix(days, cfg), asked, cfg, [anchor], None, windows, penalties), days, cfg, spec)


def laid_out(hourly: DataFrame, days: DataFrame, cfg: LedgerConfig, spec: ModelSpec) -> DataFrame:
    """Slots of hourly forecasts."""
    hourly = materialize(hourly)
    issues = hourly.select("series_id", "issue_date").distinct()
    shapes = shaping.shape_vectors(shaping.intra_hour_shape(days, cfg, issues), cfg)
    laid = shaping.to_slots(hourly, shapes, cfg)
    return laid.select(
        "series_id",
        "target_date",
        F.lit(spec.name).alias("model"),
        F.lit(spec.version).alias("model_version"),
        F.lit(spec.error_days).alias("error_days"),
        F.lit(spec.min_error_days).alias("min_error_days"),
        "horizon_days",
        "issue_date",
        "n_slots",
        "clocks",
        F.col("hourly_slots").alias("point"),
    )
