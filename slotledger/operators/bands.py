"""80 % bands from a model's own past errors, and conformal calibration of native quantiles.

Input is one row per (series, model, horizon, target) with the point vector. An issue looks at
the errors of up to ``error_days`` past targets; they are read through a range frame over days,
so the exchange carries every error once instead of once per issue that looks at it. Frames are
bounded by the error window and partitions by ``BLOCK_FACTOR`` windows of days (rows near a block
border are repeated in the next block), so neither grows with the history or with one big series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotledger.config import LedgerConfig
from slotledger.functions import arrays as a
from slotledger.functions import timecols as t

KEYS = ["series_id", "model", "model_version", "horizon_days"]
BLOCK_FACTOR = 4


def with_actuals(points: DataFrame, days: DataFrame) -> DataFrame:
    actual = days.select(
        "series_id", F.col("day").alias("target_date"), F.col("values").alias("actual")
    )
    return points.join(actual, ["series_id", "target_date"], "left")


def with_errors(points: DataFrame, days: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """Adds ``err`` (actual - point by slot), NULL as a whole where too few actuals are known."""
    joined = with_actuals(points, days)
    raw = joined.withColumn("raw_err", F.zip_with("actual", "point", lambda y, p: y - p))
    usable = F.size(a.present(F.col("raw_err"))) >= cfg.min_coverage * F.col("n_slots")
    return raw.withColumn("err", F.when(usable, F.col("raw_err"))).drop("raw_err", "actual")


def errors_by_hour(cfg: LedgerConfig) -> Column:
    """24 arrays of the known errors of a day; a doubled hour contributes all of its slots."""
    k = cfg.slots_per_hour
    regular = F.transform(
        F.sequence(F.lit(0), F.lit(23)), lambda h: a.present(F.slice("err", h * k + 1, F.lit(k)))
    )
    hours = F.transform("clocks", lambda c: F.floor(c / k).cast("int"))
    switch = a.by_bucket(F.col("err"), hours, 24)
    return F.when(F.col("n_slots") == cfg.slots_per_day, regular).otherwise(switch)


def errors_by_clock(cfg: LedgerConfig) -> Column:
    """Error vector by wall clock, a doubled hour averaged."""
    switch = F.transform(a.by_bucket(F.col("err"), F.col("clocks"), cfg.slots_per_day), a.array_mean)
    return F.when(F.col("n_slots") == cfg.slots_per_day, F.col("err")).otherwise(switch)


def past_frames(
    rows: DataFrame, records: dict[str, str], cfg: LedgerConfig, error_days: Sequence[int],
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Collect record columns of the previous ``error_days`` targets known at each row's issue.

    ``records`` maps new column names to the columns collected; NULL records are unusable days.
    """
    longest = max(error_days) - 1 + max(cfg.horizons)
    block = BLOCK_FACTOR * longest
    dayno = F.unix_date("target_date")
    blocks = F.array_distinct(
        F.array(F.floor(F.col("dayno") / block), F.floor((F.col("dayno") + longest) / block))
    )
    spread = rows.withColumn("dayno", dayno).withColumn("block", F.explode(blocks))
    base = Window.partitionBy(*keys, "block").orderBy("dayno")

    def frame(column: str) -> Column:
        picked = None
        for h in cfg.horizons:
            for n in sorted(set(error_days)):
                hit = (F.col("horizon_days") == h) & (F.col("error_days") == n)
                seen = F.collect_list(column).over(base.rangeBetween(-(n - 1 + h), -h))
                picked = F.when(hit, seen) if picked is None else picked.when(hit, seen)
        return picked

    framed = spread.select("*", *[frame(c).alias(name) for name, c in records.items()])
    own = F.col("block") == F.floor(F.col("dayno") / block)
    return framed.filter(own).drop("block", "dayno", *records.values())


def error_quantiles(errors: DataFrame, cfg: LedgerConfig, error_days: Sequence[int], tail: float = 0.1) -> DataFrame:
    """Lower and upper error quantile per local hour of every issue with enough usable days.

    One row per forecast with ``e10`` and ``e90`` by hour; an hour without errors takes its
    neighbour's. The forecast itself travels along in the row of hour 0.
    """
    nothing = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda _: F.lit(None).cast("array<double>"))
    head = F.struct("point", "clocks", "n_slots")
    keep = [*KEYS, "issue_date", "target_date", "error_days", "min_error_days"]
    hours = errors.select(
        *keep,
        head.alias("head"),
        F.posexplode(F.coalesce(F.when(F.col("err").isNotNull(), errors_by_hour(cfg)), nothing)).alias("hour", "errs"),
    ).withColumn("head", F.when(F.col("hour") == 0, F.col("head")))
    framed = past_frames(hours, {"past": "errs"}, cfg, error_days, [*KEYS, "hour"])
    enough = framed.filter(F.size("past") >= F.col("min_error_days"))
    pooled = enough.withColumn("pool", F.sort_array(F.flatten("past"))).select(
        *KEYS, "issue_date", "target_date", "hour", "head",
        F.size("past").alias("n_error_days"),
        a.sorted_quantile(F.col("pool"), tail).alias("lo"),
        a.sorted_quantile(F.col("pool"), 1 - tail).alias("hi"),
    )
    grouped = pooled.groupBy(*KEYS, "issue_date", "target_date").agg(
        F.first("head", ignorenulls=True).alias("head"),
        F.max("n_error_days").alias("n_error_days"),
        F.sort_array(F.collect_list(F.struct("hour", "lo", "hi"))).alias("hq"),
    )
    out = grouped.select(
        *KEYS, "issue_date", "target_date", "n_error_days", "head.*",
        F.transform("hq", lambda x: x["lo"]).alias("lo24"),
        F.transform("hq", lambda x: x["hi"]).alias("hi24"),
    )
    return out.select(
        *[c for c in out.columns if c not in ("lo24", "hi24")],
        a.fill_in_order(F.col("lo24")).alias("e10"),
        a.fill_in_order(F.col("hi24")).alias("e90"),
    )


def apply_bands(quantiles: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """``q10 <= q50 <= q90`` vectors from points and hourly error quantiles."""
    k = cfg.slots_per_hour
    hours = F.transform("clocks", lambda c: F.floor(c / k).cast("int"))
    edges = quantiles.withColumn("d10", F.transform(hours, lambda h: F.get(F.col("e10"), h))).withColumn(
        "d90", F.transform(hours, lambda h: F.get(F.col("e90"), h))
    )
    return edges.select(
        *KEYS, "issue_date", "target_date", "n_slots", "n_error_days",
        F.zip_with("point", "d10", lambda p, d: F.least(p + d, p)).alias("q10"),
        F.col("point").alias("q50"),
        F.zip_with("point", "d90", lambda p, d: F.greatest(p + d, p)).alias("q90"),
    )


def empirical_bands(points: DataFrame, days: DataFrame, cfg: LedgerConfig, error_days: Sequence[int]) -> DataFrame:
    """Banded vectors; targets whose issue has too few error days are absent."""
    errors = with_errors(points, days, cfg)
    return apply_bands(error_quantiles(errors, cfg, error_days), cfg)


def conformal_bands(
    points: DataFrame, days: DataFrame, cfg: LedgerConfig, error_days: Sequence[int], tail: float = 0.1
) -> DataFrame:
    """Shift native quantile vectors so each tail held ``tail`` of the calibration values.

    ``points`` carries ``raw10``, ``point`` (the median) and ``raw90``. The pool of one issue is
    bounded by the error window times the slots of a day.
    """
    joined = with_actuals(points, days)
    pairs = joined.withColumn(
        "lo_gap", a.present(F.zip_with("raw10", "actual", lambda q, y: q - y))
    ).withColumn("hi_gap", a.present(F.zip_with("actual", "raw90", lambda y, q: y - q)))
    known = F.size("lo_gap") >= cfg.min_coverage * F.col("n_slots")
    pairs = pairs.withColumn("lo_gap", F.when(known, F.col("lo_gap"))).withColumn(
        "hi_gap", F.when(known, F.col("hi_gap"))
    ).drop("actual", "clocks")
    framed = past_frames(pairs, {"lo_past": "lo_gap", "hi_past": "hi_gap"}, cfg, error_days)
    enough = framed.filter(F.size("lo_past") >= F.col("min_error_days"))
    pools = enough.withColumn("lo_pool", F.sort_array(F.flatten("lo_past"))).withColumn(
        "hi_pool", F.sort_array(F.flatten("hi_past"))
    )
    shifts = pools.withColumn("c_lo", a.sorted_quantile(F.col("lo_pool"), 1 - tail)).withColumn(
        "c_hi", a.sorted_quantile(F.col("hi_pool"), 1 - tail)
    )
    return shifts.select(
        *KEYS, "issue_date", "target_date", "n_slots", F.size("lo_past").alias("n_error_days"),
        F.zip_with("raw10", "point", lambda q, p: F.least(q - F.col("c_lo"), p)).alias("q10"),
        F.col("point").alias("q50"),
        F.zip_with("raw90", "point", lambda q, p: F.greatest(q + F.col("c_hi"), p)).alias("q90"),
        "c_lo", "c_hi",
    )


def forecast_rows(banded: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """Forecast table: one row per series, model, horizon and slot."""
    cells = F.arrays_zip(t.day_slots(F.col("target_date"), cfg).alias("slot_utc"), "q10", "q50", "q90")
    keep = [*KEYS, "issue_date", "target_date"]
    return banded.select(*keep, F.inline(cells).alias("slot_utc", "q10", "q50", "q90"))
