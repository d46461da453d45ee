"""Local calendar days, slots and wall-clock labels as column expressions.

Instants are UTC ``TIMESTAMP`` columns (session zone UTC). A delivery day is a local calendar
day, so it has more or fewer slots when the zone switches to or from daylight-saving time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotledger.config import LedgerConfig


def epoch(ts: Column) -> Column:
    return F.unix_seconds(ts)


def local_ts(ts: Column, tz: str) -> Column:
    return F.from_utc_timestamp(ts, tz)


def local_date(ts: Column, tz: str) -> Column:
    return F.to_date(local_ts(ts, tz))


def local_hour(ts: Column, tz: str) -> Column:
    return F.hour(local_ts(ts, tz))


def wall_clock(ts: Column, tz: str) -> Column:
    return F.date_format(local_ts(ts, tz), "HH:mm")


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def local_iso(ts: Column, tz: str) -> Column:
    """ISO 8601 local text with explicit offset; the repeated autumn hour stays unambiguous."""
    offset = ((epoch(local_ts(ts, tz)) - epoch(ts)) / 60).cast("int")
    return F.concat(
        F.date_format(local_ts(ts, tz), "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(offset < 0, F.lit("-")).otherwise(F.lit("+")),
        F.format_string("%02d:%02d", F.floor(F.abs(offset) / 60), F.abs(offset) % 60),
    )


def day_start(day: Column, tz: str) -> Column:
    return F.to_utc_timestamp(day.cast("timestamp"), tz)


def day_end(day: Column, tz: str) -> Column:
    return day_start(F.date_add(day, 1), tz)


def slots_in_day(day: Column, cfg: LedgerConfig) -> Column:
    span = epoch(day_end(day, cfg.tz)) - epoch(day_start(day, cfg.tz))
    return (span / cfg.slot_seconds).cast("int")


def day_slots(day: Column, cfg: LedgerConfig) -> Column:
    """All slot starts of a local day in UTC order."""
    step = F.expr(f"interval {cfg.slot_minutes} minutes")
    return F.sequence(day_start(day, cfg.tz), day_end(day, cfg.tz) - step, step)


def slot_index(ts: Column, day: Column, cfg: LedgerConfig) -> Column:
    return ((epoch(ts) - epoch(day_start(day, cfg.tz))) / cfg.slot_seconds).cast("int")


def clock_index(ts: Column, cfg: LedgerConfig) -> Column:
    """Position of the local wall-clock time within a regular day (0-based)."""
    local = local_ts(ts, cfg.tz)
    return ((F.hour(local) * 60 + F.minute(local)) / cfg.slot_minutes).cast("int")


def day_clocks(day: Column, n_slots: Column, cfg: LedgerConfig) -> Column:
    """Clock index of every slot of the day; only switch days need the zone lookup per slot."""
    return F.when(
        n_slots == cfg.slots_per_day,
        F.sequence(F.lit(0), F.lit(cfg.slots_per_day - 1)),
    ).otherwise(F.transform(day_slots(day, cfg), lambda ts: clock_index(ts, cfg)))


def sunday_anchor(day: Column) -> Column:
    return F.date_sub(day, (F.weekday(day) + 1) % 7)


def at_local_clock(day: Column, clock: str, tz: str) -> Column:
    """UTC instant of ``HH:MM`` local on a day."""
    local = F.to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(f" {clock}:00")))
    return F.to_utc_timestamp(local, tz)


def in_issue_window(ts: Column, cfg: LedgerConfig) -> Column:
    clock = wall_clock(ts, cfg.tz)
    return (clock >= cfg.earliest_issue) & (clock < cfg.deadline)


def deadline_passed(target: Column, now: Column, cfg: LedgerConfig) -> Column:
    """True once no forecast for ``target`` can be issued any more."""
    return now >= at_local_clock(F.date_sub(target, min(cfg.horizons)), cfg.deadline, cfg.tz)


def model_due(issue: Column, live_since: Column, retired_after: Column) -> Column:
    return (issue >= live_since) & (retired_after.isNull() | (issue <= retired_after))


def known_until(issue: Column, tz: str) -> Column:
    """Observations strictly before this instant are known on the issue day."""
    return day_end(issue, tz)


def covariates_known_until(issue: Column, cfg: LedgerConfig) -> Column:
    return at_local_clock(issue, cfg.earliest_issue, cfg.tz)
