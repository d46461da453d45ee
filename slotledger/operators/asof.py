"""Point-in-time access: what was known on an issue day, and proof that nothing else was used."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotledger.config import LedgerConfig
from slotledger.functions import timecols as t


def known_days(days: DataFrame, issues: DataFrame, lookback_days: int) -> DataFrame:
    """Packed days each issue may see, the last ``lookback_days`` up to the issue day itself.

    A day tells the issues that can see it, so this is an equi join of day rows. A value is known
    if its local day is not after the issue day, which is the same cut as "before the end of the
    local issue day".
    """
    visible = days.withColumn(
        "issue_date", F.explode(F.sequence("day", F.date_add("day", lookback_days - 1)))
    )
    return visible.join(issues.select("series_id", "issue_date"), ["series_id", "issue_date"], "left_semi")


def known_history(days: DataFrame, issues: DataFrame) -> DataFrame:
    """Whole history known at each issue: number and sum of its values, the first and the last one.

    Days shrink to their own totals, days to months; an issue adds the months before its own to the
    running totals inside its month. Both windows are ordered by day or month, so no issue meets every day.
    """
    present = F.filter("values", lambda v: v.isNotNull())
    own = F.struct(F.col("day").alias("at"), F.try_element_at(present, F.lit(1)).alias("v"))
    end = F.struct(F.col("day").alias("at"), F.try_element_at(present, F.lit(-1)).alias("v"))
    daily = days.filter("n_present > 0").select(
        "series_id", "day", F.size(present).cast("bigint").alias("n"),
        F.aggregate(present, F.lit(0.0), lambda x, v: x + v).alias("total"), own.alias("first"), end.alias("last"), F.lit(False).alias("asked"),
    )
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in daily.schema if f.name in ("n", "total", "first", "last")]
    asked = issues.select("series_id", F.col("issue_date").alias("day"), *empty, F.lit(True).alias("asked"))
    rows = daily.unionByName(asked).withColumn("month", F.trunc("day", "month"))
    totals = {"n": F.sum, "total": F.sum, "first": F.min, "last": F.max}
    months = rows.groupBy("series_id", "month").agg(*[f(c).alias(c) for c, f in totals.items()])
    earlier = Window.partitionBy("series_id").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    before = months.select("series_id", "month", *[f(c).over(earlier).alias(f"{c}_before") for c, f in totals.items()])
    inside = Window.partitionBy("series_id", "month").orderBy(F.unix_date("day")).rangeBetween(Window.unboundedPreceding, 0)
    running = rows.select("series_id", "month", "day", "asked", *[f(c).over(inside).alias(c) for c, f in totals.items()])
    both = running.filter("asked").join(before, ["series_id", "month"])
    return both.select(
        "series_id",
        F.col("day").alias("issue_date"),
        (F.coalesce("n", F.lit(0)) + F.coalesce("n_before", F.lit(0))).alias("n_values"),
        (F.coalesce("total", F.lit(0.0)) + F.coalesce("total_before", F.lit(0.0))).alias("total"),
        F.coalesce("first_before", "first")["v"].alias("first_value"),
        F.coalesce("last", "last_before")["v"].alias("last_value"),
    )


def known_covariates(requests: DataFrame, covariates: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """Covariates of the target day at lead ``horizon + 1`` that were published by the issue time."""
    cov = covariates.withColumn("target_date", t.local_date(F.col("valid_utc"), cfg.tz))
    asked = requests.select("series_id", "issue_date", "target_date", "horizon_days").withColumn(
        "lead_days", F.col("horizon_days") + 1
    )
    joined = asked.join(cov, ["series_id", "target_date", "lead_days"])
    return joined.filter(
        F.col("available_at_utc") <= t.covariates_known_until(F.col("issue_date"), cfg)
    )


def leaks(inputs: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """Inputs ``(series_id, issue_date, slot_utc)`` past the cutoff, summed per issue; empty if clean."""
    cutoff = t.known_until(F.col("issue_date"), cfg.tz)
    bad = inputs.filter(F.col("slot_utc") >= cutoff)
    return bad.groupBy("series_id", "issue_date").agg(
        F.count("*").alias("n_leaked"), F.max("slot_utc").alias("latest_leaked")
    )


def already_published(issues: DataFrame, fresh: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """Issues that must be refused because a later day is already visible.

    The newest slot of each series decides, so the observations shrink to one row per series.
    """
    newest = fresh.filter(F.col("value").isNotNull()).groupBy("series_id").agg(F.max("slot_utc").alias("newest"))
    joined = issues.join(newest, "series_id")
    return joined.filter(F.col("newest") >= t.known_until(F.col("issue_date"), cfg.tz)).drop("newest")


def cutoff_metadata(days: DataFrame, issues: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """First and last value used, number of values, per issue.

    Days shrink to their own first, last and count; an issue is a running total over days, read
    by value range so that issue days without observations work as well.
    """
    positions = F.filter(
        F.transform("values", lambda v, i: F.when(v.isNotNull(), i)), lambda i: i.isNotNull()
    )
    step = cfg.slot_seconds
    base = F.unix_seconds(t.day_start(F.col("day"), cfg.tz))
    daily = days.select(
        "series_id",
        F.unix_date("day").alias("dayno"),
        (base + F.array_min(positions) * step).alias("first_s"),
        (base + F.array_max(positions) * step).alias("last_s"),
        F.col("n_present").cast("bigint").alias("n"),
        F.lit(None).cast("date").alias("issue_date"),
    )
    asked = issues.select(
        "series_id",
        F.unix_date("issue_date").alias("dayno"),
        F.lit(None).cast("bigint").alias("first_s"),
        F.lit(None).cast("bigint").alias("last_s"),
        F.lit(0).cast("bigint").alias("n"),
        "issue_date",
    )
    w = Window.partitionBy("series_id").orderBy("dayno").rangeBetween(Window.unboundedPreceding, 0)
    running = daily.unionByName(asked).select(
        "series_id",
        "issue_date",
        F.min("first_s").over(w).alias("first_s"),
        F.max("last_s").over(w).alias("last_s"),
        F.sum("n").over(w).alias("n_values_used"),
    )
    return running.filter(F.col("issue_date").isNotNull()).select(
        "series_id",
        "issue_date",
        t.known_until(F.col("issue_date"), cfg.tz).alias("information_cutoff_utc"),
        F.timestamp_seconds("first_s").alias("first_value_used_utc"),
        F.timestamp_seconds("last_s").alias("last_value_used_utc"),
        "n_values_used",
    )


def covariate_cutoffs(known: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """Last publication and, per lead time, last valid hour among the covariates of an issue."""
    per_lead = known.groupBy("series_id", "issue_date", "lead_days").agg(
        F.max("valid_utc").alias("last_valid"),
        F.max("available_at_utc").alias("last_available"),
        F.count("*").alias("n"),
    )
    return per_lead.groupBy("series_id", "issue_date").agg(
        F.max("last_available").alias("last_available_at_utc"),
        F.sum("n").alias("n_values_used"),
        F.map_from_entries(F.collect_list(F.struct("lead_days", "last_valid"))).alias("last_valid_by_lead"),
    )


def tamper_differences(before: DataFrame, after: DataFrame, cutoff, keys: list[str], values: list[str]) -> DataFrame:
    """Forecasts issued up to ``cutoff`` that a change of later values altered; must be empty."""
    old = before.filter(F.col("issue_date") <= cutoff).select(*keys, F.struct(*values).alias("a"), F.lit(True).alias("in_a"))
    new = after.filter(F.col("issue_date") <= cutoff).select(*keys, F.struct(*values).alias("b"), F.lit(True).alias("in_b"))
    both = old.join(new, keys, "full_outer")
    same = F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & F.col("a").eqNullSafe(F.col("b"))
    return both.select(*keys, (~same).alias("differs"))
