"""Clock profiles, hourly shapes and feature tables built from packed days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotledger.config import LedgerConfig
from slotledger.functions import arrays as a
from slotledger.functions import timecols as t
from slotledger.functions.quantiles import exact_quantile
from slotledger.functions.holidays import calendar_features
from slotledger.models.refits import FIRST_SUNDAY


def clock_profile(cfg: LedgerConfig) -> Column:
    """Values of a packed day by wall clock; a doubled hour is averaged, a skipped one is NULL."""
    regular = F.col("n_slots") == cfg.slots_per_day
    clocks = t.day_clocks(F.col("day"), F.col("n_slots"), cfg)
    by_clock = F.transform(a.by_bucket(F.col("values"), clocks, cfg.slots_per_day), a.array_mean)
    return F.when(regular, F.col("values")).otherwise(by_clock)


def on_clocks(profile: Column, clocks: Column) -> Column:
    """A clock profile laid onto the slots of a day, then filled forward and backward."""
    return a.fill_in_order(F.transform(clocks, lambda c: F.get(profile, c)))


def usable_profiles(days: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """Profiles of the days that are complete enough to be copied."""
    enough = days.filter(F.col("n_present") / F.col("n_slots") >= cfg.min_coverage)
    return enough.select("series_id", F.col("day").alias("source_day"), clock_profile(cfg).alias("profile"))


def profile_map(requests: DataFrame, days: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """Lay the profile of ``source_day`` onto ``target_date``; requests without one drop out."""
    matched = requests.join(usable_profiles(days, cfg), ["series_id", "source_day"])
    n = t.slots_in_day(F.col("target_date"), cfg)
    laid = matched.withColumn("n_slots", n).withColumn(
        "clocks", t.day_clocks(F.col("target_date"), F.col("n_slots"), cfg)
    )
    return laid.withColumn("point", on_clocks(F.col("profile"), F.col("clocks"))).drop("profile")


def hour_means(cfg: LedgerConfig) -> Column:
    """Mean per local hour of a packed day as an array of 24, NULL for hours without data."""
    k = cfg.slots_per_hour
    clocks = t.day_clocks(F.col("day"), F.col("n_slots"), cfg)
    hours = F.transform(clocks, lambda c: F.floor(c / k).cast("int"))
    regular = F.transform(
        F.sequence(F.lit(0), F.lit(23)),
        lambda h: a.array_mean(F.slice("values", h * k + 1, F.lit(k))),
    )
    switch = F.transform(a.by_bucket(F.col("values"), hours, 24), a.array_mean)
    return F.when(F.col("n_slots") == cfg.slots_per_day, regular).otherwise(switch)


def hourly_matrix(days: DataFrame, cfg: LedgerConfig, min_hours: int | None = None) -> DataFrame:
    """``(series_id, day, hours)``: 24 local hourly values per day of a complete daily index.

    Gaps are filled only within the day. Days with fewer than ``min_hours`` known hours stay
    NULL; pass 0 for covariates, which have no minimum.
    """
    limit = cfg.min_hours_per_day if min_hours is None else min_hours
    means = days.select("series_id", "day", hour_means(cfg).alias("means"))
    known = F.size(a.present(F.col("means")))
    filled = means.select(
        "series_id",
        "day",
        F.when((known >= limit) & (known > 0), a.fill_in_order(F.col("means"))).alias("hours"),
    )
    bounds = filled.groupBy("series_id").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )
    index = bounds.select("series_id", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    return index.join(filled, ["series_id", "day"], "left")


def shifted(matrix: DataFrame, days: int, name: str) -> DataFrame:
    """The matrix keyed by the target day that is ``days`` calendar days later."""
    return matrix.select(
        "series_id", F.date_add("day", days).alias("target_date"), F.col("hours").alias(name)
    )


def lag_days(horizon: int) -> tuple[int, ...]:
    return (horizon, horizon + 1, horizon + 2, 7)


def spread_lags(matrix: DataFrame, horizon: int, extra_days: int = 7) -> DataFrame:
    """Lagged day vectors per target day in one exchange.

    Each day is sent to the target days that need it (four lags), then regrouped by target, so
    the matrix is shuffled once instead of joined to itself once per lag.
    """
    lags = sorted(set(lag_days(horizon)) | {0})
    tagged = matrix.select(
        "series_id",
        F.col("day").alias("source_day"),
        "hours",
        F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"),
    ).withColumn("target_date", F.date_add("source_day", F.col("lag")))
    picks = [
        F.max_by("hours", F.when(F.col("lag") == k, F.lit(1))).alias("target" if k == 0 else f"lag{k}")
        for k in lags
    ]
    return tagged.groupBy("series_id", "target_date").agg(*picks)


def lag_features(matrix: DataFrame, horizon: int) -> DataFrame:
    """Design of the autoregression: 96 lagged hourly values, weekday dummies, holiday flag.

    ``x`` is NULL unless every lagged hour is known; ``y`` holds the 24 target hours. Lags are
    calendar days. Target days run up to ``horizon`` days past the last observed day.
    """
    wide = spread_lags(matrix, horizon)
    last = matrix.groupBy("series_id").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )
    wide = wide.join(last, "series_id").filter(
        (F.col("target_date") >= F.col("first_day"))
        & (F.col("target_date") <= F.date_add("last_day", horizon))
    )
    cal = calendar_features(F.col("target_date"))
    calendar = F.array(*[cal[f"dow{k}"] for k in range(6)], cal["holiday"])
    lagged = [F.col(f"lag{k}") for k in lag_days(horizon)]
    x = F.concat(*lagged)
    return wide.select(
        "series_id",
        "target_date",
        F.lit(horizon).alias("horizon_days"),
        F.date_sub("target_date", horizon).alias("issue_date"),
        x.alias("x_lags"),
        calendar.alias("x_calendar"),
        F.col("target").alias("y"),
    )


def intra_hour_shape(days: DataFrame, cfg: LedgerConfig, issues: DataFrame | None = None) -> DataFrame:
    """Mean deviation of each clock slot from its hour mean over the last ``shape_days`` days.

    Each day first shrinks to its own deviations by clock; an issue then averages the sums and
    counts of its window, read through a range frame over days.
    """
    k = cfg.slots_per_hour
    clocks = t.day_clocks(F.col("day"), F.col("n_slots"), cfg)
    joined = days.withColumn("hour_mean", hour_means(cfg)).withColumn("clocks", clocks)
    dev = F.zip_with(
        "values", "clocks", lambda v, c: v - F.get(F.col("hour_mean"), F.floor(c / k).cast("int"))
    )
    rows = joined.select("series_id", "day", F.inline(F.arrays_zip(F.col("clocks").alias("clock"), dev.alias("dev"))).alias("clock", "dev"))
    per_day = rows.groupBy("series_id", "day", "clock").agg(
        F.sum("dev").alias("dev_sum"), F.count("dev").alias("dev_n")
    )
    if cfg.shape_start is not None:
        per_day = per_day.filter(F.col("day") >= F.lit(cfg.shape_start))
    dayno = F.unix_date("day")
    w = (
        Window.partitionBy("series_id", "clock")
        .orderBy("dayno")
        .rangeBetween(-(cfg.shape_days - 1), 0)
    )
    base = per_day.withColumn("dayno", dayno)
    if issues is not None:
        # issue days that have no observation of their own still need a frame
        asked = issues.select(
            "series_id",
            F.col("issue_date").alias("day"),
            F.explode(F.sequence(F.lit(0), F.lit(cfg.slots_per_day - 1))).alias("clock"),
            F.lit(None).cast("double").alias("dev_sum"),
            F.lit(0).cast("bigint").alias("dev_n"),
            F.unix_date("issue_date").alias("dayno"),
        )
        base = base.unionByName(asked)
    shaped = base.select(
        "series_id",
        F.col("day").alias("issue_date"),
        "clock",
        F.sum("dev_sum").over(w).alias("total"),
        F.sum("dev_n").over(w).alias("n"),
    )
    return shaped.groupBy("series_id", "issue_date", "clock").agg(
        F.max(F.col("total") / F.nullif(F.col("n"), F.lit(0))).alias("deviation")
    )


def shape_vectors(shape: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """The shape of an issue day as one array by clock, NULL-free (missing means no deviation)."""
    packed = shape.groupBy("series_id", "issue_date").agg(
        F.map_from_entries(F.collect_list(F.struct("clock", "deviation"))).alias("m")
    )
    return packed.select(
        "series_id",
        "issue_date",
        F.transform(
            F.sequence(F.lit(0), F.lit(cfg.slots_per_day - 1)),
            lambda c: F.coalesce(F.try_element_at(F.col("m"), c), F.lit(0.0)),
        ).alias("shape"),
    )


def to_slots(hourly: DataFrame, shapes: DataFrame, cfg: LedgerConfig, columns: tuple[str, ...] = ("hourly",)) -> DataFrame:
    """Hourly forecasts (arrays of 24) on the slots of the target day plus the usual shape."""
    flat = F.transform(F.sequence(F.lit(1), F.lit(cfg.slots_per_day)), lambda _: F.lit(0.0))
    joined = hourly.join(shapes, ["series_id", "issue_date"], "left").withColumn(
        "shape", F.coalesce("shape", flat)
    )
    n = t.slots_in_day(F.col("target_date"), cfg)
    laid = joined.withColumn("n_slots", n).withColumn(
        "clocks", t.day_clocks(F.col("target_date"), F.col("n_slots"), cfg)
    )

    def spread(name: str) -> Column:
        return F.transform(
            "clocks",
            lambda c: F.get(F.col(name), F.floor(c / cfg.slots_per_hour).cast("int"))
            + F.get(F.col("shape"), c),
        )

    out = laid.select("*", *[spread(c).alias(f"{c}_slots") for c in columns])
    return out.drop("shape", *columns)


def robust_scale(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and MAD/0.6745 per group of a training window; a flat column scales by one."""
    med = exact_quantile(rows, keys, value, 0.5, "center")
    away = rows.join(med, keys).withColumn("away", F.abs(F.col(value) - F.col("center")))
    spread = exact_quantile(away, keys, "away", 0.5, "mad").withColumn("mad", F.col("mad") / 0.6745).join(med, keys)
    return spread.select(
        *keys, "center", F.when(F.col("mad") > 1e-9, F.col("mad")).otherwise(F.lit(1.0)).alias("scale")
    )


def _middle(values: Column) -> Column:
    """Median of an ordered array."""
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2


def rolling_scale(rows: DataFrame, keys: list[str], day: str, value: str, every: int, windows: Sequence[int]) -> DataFrame:
    """Median and MAD/0.6745 of every training window: the days up to an anchor of the refit grid, ``every`` days apart, for each window length.

    One scan and one exchange serve all anchors and lengths. A value crosses it ``sum(windows) / every`` times, packed in arrays that are
    partly collected before; a group holds one window's values of its keys, not the history. Every anchor whose window holds a value has
    a row; NULLs count nowhere, a flat window scales by one.
    """
    number = F.unix_date(day)
    first = number + F.pmod(F.unix_date(F.lit(FIRST_SUNDAY)) - number, F.lit(every))

    def served(window: int) -> Column:
        last = number + window - 1
        anchors = F.when(first <= last, F.sequence(first, last, F.lit(every))).otherwise(F.array().cast("array<int>"))
        return F.transform(anchors, lambda a: F.struct(a.alias("anchor"), F.lit(window).alias("window_days")))

    known = rows.filter(F.col(value).isNotNull())
    copies = known.select(*keys, F.col(value).alias("v"), F.inline(F.concat(*[served(w) for w in windows])))
    packed = copies.groupBy(*keys, "anchor", "window_days").agg(F.sort_array(F.collect_list("v")).alias("v"))
    centred = packed.withColumn("center", _middle(F.col("v")))
    away = F.array_sort(F.transform("v", lambda x: F.abs(x - F.col("center"))))
    spread = centred.withColumn("away", away).withColumn("mad", _middle(F.col("away")) / 0.6745)
    return spread.select(
        *keys, F.date_from_unix_date("anchor").alias("anchor"), "window_days", F.size("v").cast("bigint").alias("n_values"),
        "center", F.when(F.col("mad") > 1e-9, F.col("mad")).otherwise(F.lit(1.0)).alias("scale"),
    )
