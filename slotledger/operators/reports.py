"""Views on the ledger: status per day, ranked metrics, day cards and hints on bad days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotledger.config import REFERENCE_MODEL, LedgerConfig
from slotledger.functions import arrays as a
from slotledger.functions import timecols as t
from slotledger.functions.holidays import holiday_name
from slotledger.models.requests import model_key
from slotledger.operators.summary import featured_model, scored, worst_days

P_LIMIT = 0.05
HISTORY_DAYS = 90
MIN_HISTORY_DAYS = 30
LEDGER_ROWS = 14
WORST_LIVE = 8
WORST_BACKTEST = 4


def _local_clock(slots: Column, i: Column, cfg: LedgerConfig) -> Column:
    return t.wall_clock(F.get(slots, i), cfg.tz)


def _first_argmax(arr: Column) -> Column:
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def forecast_day_card(banded: DataFrame, days: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """Mean, minimum and maximum of each median forecast, when they occur, and MAE once known."""
    actual = days.filter(F.col("n_present") == F.col("n_slots")).select(
        "series_id", F.col("day").alias("target_date"), F.col("values").alias("actual")
    )
    rows = banded.join(actual, ["series_id", "target_date"], "left")
    rows = rows.withColumn("slots", t.day_slots(F.col("target_date"), cfg))
    abs_err = F.zip_with("actual", "q50", lambda y, q: F.abs(y - q))
    return rows.select(
        "series_id", "issue_date", model_key().alias("model_key"), "horizon_days", "target_date",
        a.array_mean(F.col("q50")).alias("day_mean"),
        F.array_min("q50").alias("min"),
        _local_clock(F.col("slots"), a.first_argmin(F.col("q50")), cfg).alias("min_at"),
        F.array_max("q50").alias("max"),
        _local_clock(F.col("slots"), _first_argmax(F.col("q50")), cfg).alias("max_at"),
        F.when(F.col("actual").isNotNull(), a.array_mean(abs_err)).alias("mae"),
    )


def status_ledger(
    due: DataFrame, daily: DataFrame, issued: DataFrame, today: Column, models: Sequence[str], cfg: LedgerConfig
) -> DataFrame:
    """The most recent delivery days: MAE, ``missed`` or ``pending`` per model at horizon 1.

    ``due`` has one row per series, model and target; ``issued`` one per series, issue and model
    with ``issued_at_utc``.
    """
    grid = due.filter(F.col("horizon_days") == 1).withColumn("model_key", model_key())
    first = grid.groupBy("series_id").agg(
        F.min("target_date").alias("first_target"), F.max("target_date").alias("last_target")
    )
    grid = grid.join(first, "series_id").filter(
        F.col("target_date") > F.date_sub("last_target", LEDGER_ROWS)
    )
    d1 = daily.filter(F.col("horizon_days") == 1).select("series_id", "model_key", "target_date", "status", "mae")
    made = issued.select("series_id", "issue_date", model_key().alias("model_key"), "issued_at_utc")
    rows = grid.join(d1, ["series_id", "model_key", "target_date"], "left").join(
        made, ["series_id", "issue_date", "model_key"], "left"
    )
    absent = F.col("issued_at_utc").isNull() & (F.col("issue_date") < today)
    cell = (
        F.when(F.col("status") == "scored", F.format_string("%.1f", F.bround("mae", 1)))
        .when(F.col("status").isin("missed", "incomplete") | absent, "missed")
        .otherwise("pending")
    )
    # the reference model's issue time is shown; without it, any model's of that day
    shown = F.coalesce(
        F.min(F.when(F.col("model_key") == REFERENCE_MODEL, F.col("issued_at_utc"))), F.min("issued_at_utc")
    )
    rows = rows.withColumn("cell", cell).withColumn("entry", F.datediff("target_date", "first_target") + 1)
    keys = ["series_id", "target_date", "issue_date", "entry"]
    issue_times = rows.groupBy(*keys).agg(t.wall_clock(shown, cfg.tz).alias("issued_local"))
    cells = rows.groupBy(*keys).pivot("model_key", list(models)).agg(F.first("cell"))
    return cells.join(issue_times, keys)


def metric_table(cube: DataFrame, reference: str = REFERENCE_MODEL) -> DataFrame:
    """Headline rows of each window and horizon: reference first, then by MAE."""
    rows = cube.filter(F.col("segment") == "all").withColumn("is_reference", F.col("model_key") == reference)
    w = Window.partitionBy("series_id", "window", "horizon_days").orderBy(
        F.col("is_reference").desc(), F.col("mae").asc_nulls_last(), "model_key"
    )
    return rows.select(
        "series_id", "window", "horizon_days", F.row_number().over(w).alias("position"), "model_key",
        "is_reference", "days_due", "days_forecast",
        (F.col("days_due") - F.col("days_forecast")).alias("missed"),
        "mae", "rmse", "skill_mae", "pinball", "coverage_80",
    )


def dm_verdicts(tests: DataFrame) -> DataFrame:
    """Which model of a pair is better, if the difference is significant."""
    better = F.when(F.col("statistic") < 0, F.col("model_a")).otherwise(F.col("model_b"))
    verdict = (
        F.when(F.col("p_value").isNull(), "too_few_days")
        .when(F.col("p_value") < P_LIMIT, F.concat(better, F.lit(" better")))
        .otherwise("no_significant_difference")
    )
    return tests.withColumn("verdict", verdict)


def headline(cube: DataFrame, tests: DataFrame, hits: DataFrame, reference: str = REFERENCE_MODEL) -> DataFrame:
    """All-time table by horizon and MAE with the test against the reference and window hit rates."""
    rows = cube.filter((F.col("window") == "all") & (F.col("segment") == "all"))
    involved = tests.filter(
        (F.col("window") == "all") & ((F.col("model_a") == reference) | (F.col("model_b") == reference))
    )
    other = F.when(F.col("model_a") == reference, F.col("model_b")).otherwise(F.col("model_a"))
    against = involved.select("series_id", "horizon_days", other.alias("model_key"), "statistic", "p_value")
    window = hits.filter(F.col("window") == "all").select(
        "series_id", "horizon_days", "model_key", "hit_rate", "mean_p_cheapest", "near_rate", "mean_p_near", "saving_vs_day_mean"
    )
    keys = ["series_id", "horizon_days", "model_key"]
    joined = rows.join(against, keys, "left").join(window, keys, "left")
    w = Window.partitionBy("series_id").orderBy("horizon_days", F.col("mae").asc_nulls_last(), "model_key")
    return joined.select(
        *keys, F.row_number().over(w).alias("position"), "days_due", "days_forecast", "mae", "rmse",
        "skill_mae", "pinball", "coverage_80", "statistic", "p_value", "hit_rate", "mean_p_cheapest",
        "near_rate", "mean_p_near", "saving_vs_day_mean",
    )


def day_statistics(days: DataFrame) -> DataFrame:
    known = a.present(F.col("values"))
    return days.filter(F.col("n_present") > 0).select(
        "series_id",
        F.col("day").alias("target_date"),
        "n_slots",
        "n_present",
        a.array_mean(F.col("values")).alias("mean"),
        F.array_min("values").alias("min"),
        F.array_max("values").alias("max"),
        F.size(F.filter(known, lambda x: x < 0)).alias("n_negative"),
    )


def miss_diagnostics(days: DataFrame, banded: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """Hints per scored forecast why its day may have been hard, from the values alone.

    Days shrink to one row of statistics first; the 90-day history is a range frame over them.
    """
    stats = day_statistics(days).withColumn("dayno", F.unix_date("target_date"))
    w = Window.partitionBy("series_id").orderBy("dayno").rangeBetween(-HISTORY_DAYS, -1)
    history = stats.select(
        "*",
        F.sum("n_present").over(w).alias("hist_slots"),
        F.sort_array(F.collect_list("max").over(w)).alias("maxima"),
        F.sort_array(F.collect_list(F.col("max") - F.col("min")).over(w)).alias("spreads"),
    )
    usual = history.select(
        "series_id", "target_date", "n_slots", "mean", "min", "max", "n_negative",
        (F.coalesce("hist_slots", F.lit(0)) > cfg.slots_per_day * MIN_HISTORY_DAYS).alias("has_history"),
        a.sorted_quantile(F.col("maxima"), 0.95).alias("usual_max"),
        a.sorted_quantile(F.col("spreads"), 0.5).alias("usual_spread"),
    )
    before = stats.select("series_id", F.col("target_date").alias("issue_date"), F.col("mean").alias("mean_before"))
    actual = days.select("series_id", F.col("day").alias("target_date"), F.col("values").alias("actual"))
    keys = ["series_id", "model_key", "horizon_days", "target_date"]
    rows = (
        banded.select("series_id", model_key().alias("model_key"), "horizon_days", "issue_date", "target_date", "q50")
        .join(usual, ["series_id", "target_date"])
        .join(actual, ["series_id", "target_date"])
        .join(before, ["series_id", "issue_date"], "left")
    )
    rows = rows.withColumn("miss", F.zip_with("q50", "actual", lambda q, y: q - y))
    rows = rows.withColumn("bias", a.array_mean(F.col("miss"))).withColumn(
        "abs_miss", F.transform("miss", F.abs)
    )
    today, yesterday = holiday_name(F.col("target_date")), holiday_name(F.date_sub("target_date", 1))
    flags = F.array_compact(
        F.array(
            F.when(F.abs(F.col("mean") - F.col("mean_before")) >= cfg.level_jump, "level_jump"),
            F.when(F.col("n_negative") > 0, "negative"),
            F.when(F.col("has_history") & (F.col("max") > F.col("usual_max")), "spike"),
            F.when(F.col("has_history") & (F.col("max") - F.col("min") > 1.5 * F.col("usual_spread")), "spread"),
            F.when(today.isNotNull(), "holiday").when(yesterday.isNotNull(), "after_holiday"),
            F.when(F.col("n_slots") != cfg.slots_per_day, "clock_change"),
        )
    )
    details = F.array_compact(
        F.array(
            F.when(F.col("bias") >= cfg.bias_limit, "bias_high").when(F.col("bias") <= -cfg.bias_limit, "bias_low")
        )
    )
    worst = _first_argmax(F.col("abs_miss"))
    rows = rows.withColumn("flags", flags).withColumn("worst", worst)
    slots = t.day_slots(F.col("target_date"), cfg)
    return rows.select(
        *keys,
        F.concat(F.when(F.size("flags") > 0, F.col("flags")).otherwise(F.array(F.lit("none"))), details).alias("reasons"),
        "n_negative", "mean", "mean_before", "bias",
        _local_clock(slots, F.col("worst"), cfg).alias("worst_at"),
        F.get("q50", "worst").alias("worst_forecast"),
        F.get("actual", "worst").alias("worst_actual"),
    )


def failure_cards(daily: DataFrame, diagnostics: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """Worst days at horizon 1: of the featured model (live) and of every model (backtest)."""
    d1 = daily.filter(F.col("horizon_days") == 1)
    keys = ["series_id", "model_key"]
    chosen = featured_model(daily, cfg).select("series_id", F.col("featured_model").alias("model_key"))
    live = worst_days(d1.join(chosen, keys, "left_semi"), WORST_LIVE, keys).withColumn("source", F.lit("live"))
    past = worst_days(d1, WORST_BACKTEST, keys).withColumn("source", F.lit("backtest"))
    cards = live.unionByName(past).select("source", *keys, "horizon_days", "target_date", "rank", "mae")
    return cards.join(diagnostics, [*keys, "horizon_days", "target_date"], "left")
