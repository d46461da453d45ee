"""Feature table of the pooled tree model: lagged values, covariates and calendar per hour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotledger.config import LedgerConfig
from slotledger.functions import arrays as a
from slotledger.functions import timecols as t
from slotledger.functions.holidays import calendar_features
from slotledger.sources.feeds import WEATHER_FEATURES

WEEK_ROWS = 7
WEEK_MIN = 5

FEATURE_COLUMNS = (
    "p_last_hour", "p_last2_hour", "p_week_hour", *WEATHER_FEATURES,
    "p_last_mean", "p_last_min", "p_last_max", "p_week_mean",
    "wind_power_day", "solar_day", "temp_day", "wind_power_last_day", "solar_last_day",
    "wind_power_change", "solar_change", "doy_sin", "doy_cos", "weekday", "weekend", "holiday", "hour",
)


def covariate_matrix(covariates: DataFrame, cfg: LedgerConfig, features: Sequence[str] = WEATHER_FEATURES) -> DataFrame:
    """``(series_id, lead_days, day, <feature> arrays of 24)``, gaps filled within the day."""
    local = covariates.select(
        "series_id",
        "lead_days",
        t.local_date(F.col("valid_utc"), cfg.tz).alias("day"),
        t.local_hour(F.col("valid_utc"), cfg.tz).alias("hour"),
        *features,
    )
    hourly = local.groupBy("series_id", "lead_days", "day", "hour").agg(*[F.avg(f).alias(f) for f in features])
    packed = hourly.groupBy("series_id", "lead_days", "day").agg(
        F.map_from_entries(F.collect_list(F.struct("hour", F.struct(*features)))).alias("m")
    )

    def vector(f: str) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(23)), lambda h: F.try_element_at(F.col("m"), h)[f]
        )

    wide = packed.select("series_id", "lead_days", "day", *[vector(f).alias(f) for f in features])
    return wide.select("series_id", "lead_days", "day", *[a.fill_in_order(F.col(f)).alias(f) for f in features])


def align_lags(rows: DataFrame, columns: Sequence[str], lags: Sequence[int]) -> DataFrame:
    """``<column>_<lag>`` per target day: every day is sent to the targets that need it, once."""
    tagged = rows.select(
        "series_id", "day", *columns, F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag")
    ).withColumn("target_date", F.date_add("day", F.col("lag")))
    picks = [
        F.max_by(c, F.when(F.col("lag") == k, F.lit(1))).alias(f"{c}_{k}") for c in columns for k in lags
    ]
    return tagged.groupBy("series_id", "target_date").agg(*picks)


def pooled_features(matrix: DataFrame, covariates: DataFrame, horizon: int) -> DataFrame:
    """One row per series, target day and hour with all features and the relative target.

    ``matrix`` is the hourly price matrix, ``covariates`` the covariate matrix. The target is the
    price minus the mean of the last seven known days.
    """
    daily = matrix.select(
        "series_id",
        "day",
        "hours",
        a.array_mean(F.col("hours")).alias("day_mean"),
        F.array_min("hours").alias("day_min"),
        F.array_max("hours").alias("day_max"),
        F.unix_date("day").alias("dayno"),
    )
    week = Window.partitionBy("series_id").orderBy("dayno").rangeBetween(-(WEEK_ROWS - 1), 0)
    daily = daily.withColumn(
        "week_mean", F.when(F.count("day_mean").over(week) >= WEEK_MIN, F.avg("day_mean").over(week))
    )
    stats = F.struct("hours", "day_mean", "day_min", "day_max", "week_mean")
    prices = align_lags(daily.select("series_id", "day", stats.alias("p")), ["p"], [0, horizon, horizon + 1, 7])
    cov = covariates.filter(F.col("lead_days") == horizon + 1)
    cov = cov.select(
        "series_id",
        "day",
        F.struct(
            *WEATHER_FEATURES,
            *[a.array_mean(F.col(f)).alias(f"{f}_mean") for f in ("wind_power", "solar", "temp")],
        ).alias("x"),
    )
    weather = align_lags(cov, ["x"], [0, horizon])
    last, now, past = F.col(f"p_{horizon}"), F.col("x_0"), F.col(f"x_{horizon}")
    joined = prices.join(weather, ["series_id", "target_date"], "left")
    cal = calendar_features(F.col("target_date"))
    per_day = joined.select(
        "series_id",
        "target_date",
        F.lit(horizon).alias("horizon_days"),
        F.date_sub("target_date", horizon).alias("issue_date"),
        last["day_mean"].alias("p_last_mean"),
        last["day_min"].alias("p_last_min"),
        last["day_max"].alias("p_last_max"),
        last["week_mean"].alias("p_week_mean"),
        now["wind_power_mean"].alias("wind_power_day"),
        now["solar_mean"].alias("solar_day"),
        now["temp_mean"].alias("temp_day"),
        past["wind_power_mean"].alias("wind_power_last_day"),
        past["solar_mean"].alias("solar_last_day"),
        (now["wind_power_mean"] - past["wind_power_mean"]).alias("wind_power_change"),
        (now["solar_mean"] - past["solar_mean"]).alias("solar_change"),
        cal["doy_sin"].alias("doy_sin"),
        cal["doy_cos"].alias("doy_cos"),
        F.weekday("target_date").cast("double").alias("weekday"),
        cal["weekend"].alias("weekend"),
        cal["holiday"].alias("holiday"),
        F.transform(
            F.sequence(F.lit(0), F.lit(23)),
            lambda h: F.struct(
                h.cast("double").alias("hour"),
                F.get(last["hours"], h).alias("p_last_hour"),
                F.get(F.col(f"p_{horizon + 1}")["hours"], h).alias("p_last2_hour"),
                F.get(F.col("p_7")["hours"], h).alias("p_week_hour"),
                *[F.get(now[f], h).alias(f) for f in WEATHER_FEATURES],
                F.get(F.col("p_0")["hours"], h).alias("price"),
            ),
        ).alias("by_hour"),
    )
    rows = per_day.select("*", F.inline("by_hour")).drop("by_hour")
    return rows.withColumn("y", F.col("price") - F.col("p_week_mean"))
