"""Local days, clocks, holidays and due rules on the order and line dates (1995 to 2001)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from slotledger.bindings import panels as p
from slotledger.catalog import sql as q
from slotledger.catalog.base import query, r, utc
from slotledger.config import LedgerConfig, ModelSpec
from slotledger.functions import timecols as t
from slotledger.functions.holidays import calendar_features, holiday_name
from slotledger.functions.losses import wind_power
from slotledger.models.requests import forecast_requests

CFG = LedgerConfig()
TZ = CFG.tz

DAYS_SQL = "days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)"
# Instants spread over the clock: order dates plus a quarter-hour taken from the order key.
INSTANTS_SQL = "ins AS (SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 + (o_orderkey % 96) * 900 AS s FROM orders)"


def order_days(spark, sf):
    return p.read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()


def instants(spark, sf):
    base = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 96) * 900
    return p.read(spark, sf, "orders").select("o_orderkey", F.timestamp_seconds(base).alias("ts"))


@query(
    "local_day_bounds",
    q.with_(DAYS_SQL)
    + f"SELECT day, {q.utc_text(q.day_start('day'))} AS start_utc, {q.utc_text(q.day_start('day + 1'))} AS end_utc FROM days",
)
def local_day_bounds(spark, sf):
    d = F.col("day")
    return order_days(spark, sf).select("day", t.utc_text(t.day_start(d, TZ)).alias("start_utc"), t.utc_text(t.day_end(d, TZ)).alias("end_utc"))


@query(
    "day_slots",
    q.with_(DAYS_SQL, f"x AS (SELECT day, unnest(range({q.day_start('day')}, {q.day_start('day + 1')}, 900)) AS s FROM days)")
    + f"SELECT day, {q.utc_text('s')} AS slot FROM x",
)
def day_slots(spark, sf):
    rows = order_days(spark, sf).select("day", F.explode(t.day_slots(F.col("day"), CFG)).alias("slot"))
    return rows.withColumn("slot", utc("slot"))


@query("wall_clock", q.with_(INSTANTS_SQL) + f"SELECT o_orderkey, strftime({q.local('s')}, '%H:%M') AS clock FROM ins")
def wall_clock(spark, sf):
    return instants(spark, sf).select("o_orderkey", t.wall_clock(F.col("ts"), TZ).alias("clock"))


@query("local_iso", q.with_(INSTANTS_SQL) + f"SELECT o_orderkey, {q.local_iso('s')} AS local FROM ins")
def local_iso(spark, sf):
    return instants(spark, sf).select("o_orderkey", t.local_iso(F.col("ts"), TZ).alias("local"))


@query("local_date", q.with_(INSTANTS_SQL) + f"SELECT o_orderkey, CAST({q.local('s')} AS DATE) AS local_date FROM ins")
def local_date(spark, sf):
    return instants(spark, sf).select("o_orderkey", t.local_date(F.col("ts"), TZ).alias("local_date"))


def _holidays_sql() -> str:
    from slotledger.catalog.reports import HOLIDAYS_SQL

    return HOLIDAYS_SQL


@query("holiday_flag", q.with_(DAYS_SQL, _holidays_sql()) + "SELECT day, h.d IS NOT NULL AS holiday, h.name FROM days LEFT JOIN hol h ON h.d = day")
def holiday_flag(spark, sf):
    name = holiday_name(F.col("day"))
    return order_days(spark, sf).select("day", name.isNotNull().alias("holiday"), name.alias("name"))


_ANGLE = "(2 * pi() * dayofyear(day) / 365.25::DOUBLE)"


@query(
    "calendar_features",
    q.with_(DAYS_SQL, _holidays_sql())
    + f"""SELECT day, {", ".join(f"CAST(isodow(day) = {k + 1} AS INTEGER)::DOUBLE AS dow{k}" for k in range(6))},
  CAST(isodow(day) >= 6 AS INTEGER)::DOUBLE AS weekend, CAST(h.d IS NOT NULL AS INTEGER)::DOUBLE AS holiday,
  {q.r(f'sin({_ANGLE})', 9)} AS doy_sin, {q.r(f'cos({_ANGLE})', 9)} AS doy_cos FROM days LEFT JOIN hol h ON h.d = day""",
)
def calendar_feature_table(spark, sf):
    f = calendar_features(F.col("day"))
    rounded = {n: r(c, 9) if n.startswith("doy") else c for n, c in f.items()}
    return order_days(spark, sf).select("day", *[c.alias(n) for n, c in rounded.items()])


@query("sunday_anchor", q.with_(DAYS_SQL) + "SELECT day, CAST(day - CAST(isodow(day) % 7 AS INTEGER) AS DATE) AS anchor FROM days")
def sunday_anchor(spark, sf):
    return order_days(spark, sf).select("day", t.sunday_anchor(F.col("day")).alias("anchor"))


@query(
    "wind_power_proxy",
    f"""SELECT l_orderkey, l_linenumber, {q.r('CASE WHEN v > 25 THEN 0 ELSE pow(least(greatest((v - 3) / 9, 0), 1), 3) END', 9)} AS wind_power
FROM (SELECT l_orderkey, l_linenumber, l_quantity + l_discount AS v FROM lineitem)""",
)
def wind_power_proxy(spark, sf):
    v = F.col("l_quantity") + F.col("l_discount")
    return p.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r(wind_power(v), 9).alias("wind_power"))


@query(
    "issue_window_check",
    q.with_(INSTANTS_SQL)
    + f"""SELECT o_orderkey, strftime({q.local('s')}, '%H:%M') AS clock,
  CASE WHEN strftime({q.local('s')}, '%H:%M') < '08:45' THEN 'too_early' WHEN strftime({q.local('s')}, '%H:%M') >= '12:00' THEN 'deadline_passed' ELSE 'open' END AS state FROM ins""",
)
def issue_window_check(spark, sf):
    clock = t.wall_clock(F.col("ts"), TZ)
    state = F.when(t.in_issue_window(F.col("ts"), CFG), "open").when(clock < CFG.earliest_issue, "too_early").otherwise("deadline_passed")
    return instants(spark, sf).select("o_orderkey", clock.alias("clock"), state.alias("state"))


@query(
    "deadline_passed",
    q.with_(INSTANTS_SQL, f"x AS (SELECT o_orderkey, s, CAST({q.local('s')} AS DATE) + 1 AS target FROM ins)")
    + f"SELECT o_orderkey, target AS target_date, s >= {q.at_clock('target - 1', '12:00')} AS passed FROM x",
)
def deadline_passed(spark, sf):
    rows = instants(spark, sf).withColumn("target_date", F.date_add(t.local_date(F.col("ts"), TZ), 1))
    return rows.select("o_orderkey", "target_date", t.deadline_passed(F.col("target_date"), F.col("ts"), CFG).alias("passed"))


_SPECS = (
    ModelSpec("first", live_since=date(1995, 6, 1), retired_after=date(1998, 3, 29)),
    ModelSpec("second", live_since=date(1998, 3, 30)),
)


@query(
    "model_due",
    q.with_(DAYS_SQL)
    + """SELECT m.model, h.h AS horizon_days, day AS target_date, day - h.h AS issue_date,
  day - h.h >= m.since AND (m.until IS NULL OR day - h.h <= m.until) AS due
FROM days, (VALUES ('first', DATE '1995-06-01', DATE '1998-03-29'), ('second', DATE '1998-03-30', NULL)) m(model, since, until), (VALUES (1), (2)) h(h)""",
)
def model_due(spark, sf):
    targets = order_days(spark, sf).select(F.lit("orders").alias("series_id"), F.col("day").alias("target_date"))
    grid = forecast_requests(targets, _SPECS, CFG)
    due = t.model_due(F.col("issue_date"), F.col("live_since"), F.col("retired_after"))
    return grid.select("model", "horizon_days", "target_date", "issue_date", due.alias("due"))
