"""What was known when: cutoffs, guards and the proof that later values change nothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotledger.bindings import panels as p
from slotledger.catalog import sql as q
from slotledger.catalog.base import BACKTEST_SPECS, ev_days, query, utc
from slotledger.functions import timecols as t
from slotledger.models.requests import forecast_requests
from slotledger.operators import asof, bands
from slotledger.plans import backtest as bt
from slotledger.sources import feeds

CFG, H = p.QUARTER, p.HOURLY


def issues_of(days):
    return days.select("series_id", F.col("day").alias("issue_date"))


@query(
    "known_prices_asof",
    q.with_(*q.panel("ev15"))
    + f"""SELECT i.series_id, i.day AS issue_date, {q.utc_text('p.s')} AS slot, p.y AS value
FROM dd i JOIN pan p ON p.series_id = i.series_id AND p.s < {q.day_start('i.day + 1')} AND p.day > i.day - 3""",
)
def known_prices_asof(spark, sf):
    """Slots of the last three days each issue day may see."""
    days = ev_days(spark, sf)
    known = asof.known_days(days, issues_of(days), 3)
    cells = F.arrays_zip(t.day_slots(F.col("day"), CFG).alias("slot"), F.col("values").alias("value"))
    return known.select("series_id", "issue_date", F.inline(cells).alias("slot", "value")).withColumn("slot", utc("slot"))


@query(
    "known_history_asof",
    q.with_(*q.panel("li60", fill=False))
    + f"""SELECT i.series_id, i.day AS issue_date, count(*) AS n_values, CAST(sum(o.v) AS DOUBLE) AS total, arg_min(o.v, o.s) AS first_value, arg_max(o.v, o.s) AS last_value
FROM dd i JOIN obs o ON o.series_id = i.series_id AND o.s < {q.day_start('i.day + 1')} GROUP BY 1, 2""",
)
def known_history_asof(spark, sf):
    """Everything each issue day of the line panel may see, over the years."""
    days = p.line_days(spark, sf, fill=False)
    return asof.known_history(days, issues_of(days))


_COV_SQL = """cov AS (SELECT event_type AS series_id, (epoch_us(ts) // 1000000) // 3600 * 3600 AS s, l.lead, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS x,
    (epoch_us(min(ts)) // 1000000) // 3600 * 3600 - l.lead * 86400 + 6 * 3600 AS avail FROM events, (VALUES (2), (3)) l(lead) GROUP BY 1, 2, 3)"""


def covariates(spark, sf):
    """Hourly event sums as if forecast two and three days ahead."""
    ev = p.read(spark, sf, "events").select(
        F.col("event_type").alias("series_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("valid_utc"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )
    hourly = ev.groupBy("series_id", "valid_utc").agg(F.sum("cents").alias("x"))
    rows = hourly.withColumn("lead_days", F.explode(F.array(F.lit(2), F.lit(3))))
    return rows.withColumn("available_at_utc", feeds.available_at(H))


def ev_requests(spark, sf):
    days = p.event_days(spark, sf, H, fill=False)
    return forecast_requests(bt.targets_of(days, H), BACKTEST_SPECS[:1], H)


_KNOWN_COV = [
    *q.panel("ev60", fill=False)[:3],
    *q.points("ev60")[:2],
    _COV_SQL,
    f"""kc AS (SELECT q.series_id, q.issue_date, q.target_date, q.h, c.s, c.x, c.lead, c.avail FROM req q
  JOIN cov c ON c.series_id = q.series_id AND c.lead = q.h + 1 AND CAST({q.local('c.s')} AS DATE) = q.target_date
  WHERE q.model = 'naive_last_day' AND c.avail <= {q.at_clock('q.issue_date', '08:45')})""",
]


@query(
    "known_covariates_asof",
    q.with_(*_KNOWN_COV) + f"SELECT series_id, issue_date, target_date, h AS horizon_days, {q.utc_text('s')} AS valid_utc, x, {q.utc_text('avail')} AS available_at_utc FROM kc",
)
def known_covariates_asof(spark, sf):
    k = asof.known_covariates(ev_requests(spark, sf), covariates(spark, sf), H)
    return k.select("series_id", "issue_date", "target_date", "horizon_days", utc("valid_utc").alias("valid_utc"), "x", utc("available_at_utc").alias("available_at_utc"))


@query(
    "leak_check",
    q.with_(*q.panel("ev60", fill=False))
    + f"""SELECT i.series_id, i.day AS issue_date, count(*) AS n_leaked, {q.utc_text('max(o.s)')} AS latest_leaked
FROM dd i JOIN obs o ON o.series_id = i.series_id AND o.day BETWEEN i.day - 1 AND i.day + 1 AND o.s >= {q.day_start('i.day + 1')} GROUP BY ALL""",
)
def leak_check(spark, sf):
    """Inputs that wrongly reach one day past each issue; the check must name every one."""
    days = p.event_days(spark, sf, H, fill=False)
    reach = days.withColumn("issue_date", F.explode(F.sequence(F.date_sub("day", 1), F.date_add("day", 1))))
    inputs = reach.join(issues_of(days), ["series_id", "issue_date"], "left_semi")
    cells = F.arrays_zip(t.day_slots(F.col("day"), H).alias("slot_utc"), F.col("values").alias("value"))
    slots = inputs.select("series_id", "issue_date", F.inline(cells).alias("slot_utc", "value")).filter(F.col("value").isNotNull())
    found = asof.leaks(slots, H)
    return found.select("series_id", "issue_date", "n_leaked", utc("latest_leaked").alias("latest_leaked"))


@query(
    "already_published_guard",
    q.with_(*q.panel("ev60", fill=False)[:3], "mx AS (SELECT series_id, max(s) AS s FROM raw GROUP BY 1)")
    + f"SELECT i.series_id, i.day AS issue_date FROM dd i JOIN mx USING (series_id) WHERE mx.s >= {q.day_start('i.day + 1')}",
)
def already_published_guard(spark, sf):
    obs = p.event_slots(spark, sf, H)
    issues = obs.select("series_id", t.local_date(F.col("slot_utc"), H.tz).alias("issue_date")).distinct()
    return asof.already_published(issues, obs, H)


@query(
    "cutoff_metadata",
    q.with_(
        *_KNOWN_COV, *q.panel("ev60", fill=False)[3:],
        f"""um AS (SELECT i.series_id, i.day AS issue_date, min(o.s) AS fs, max(o.s) AS ls, count(*) AS n FROM dd i JOIN obs o ON o.series_id = i.series_id AND o.s < {q.day_start('i.day + 1')} GROUP BY ALL)""",
        """cm AS (SELECT series_id, issue_date, max(avail) AS av, max(CASE WHEN lead = 2 THEN s END) AS l2, max(CASE WHEN lead = 3 THEN s END) AS l3, count(*) AS nc FROM kc GROUP BY ALL)""",
    )
    + f"""SELECT u.series_id, u.issue_date, {q.utc_text(q.day_start('u.issue_date + 1'))} AS information_cutoff_utc, {q.utc_text('fs')} AS first_value_used_utc, {q.utc_text('ls')} AS last_value_used_utc, n AS n_values_used,
  {q.utc_text('av')} AS last_covariate_at_utc, {q.utc_text('l2')} AS lead_2_last_valid_utc, {q.utc_text('l3')} AS lead_3_last_valid_utc, CAST(nc AS DOUBLE) AS n_covariates
FROM um u LEFT JOIN cm c USING (series_id, issue_date)""",
)
def cutoff_metadata(spark, sf):
    """Data cutoffs of every issue day: values used, and covariates per lead time."""
    days = p.event_days(spark, sf, H, fill=False)
    used = asof.cutoff_metadata(days, issues_of(days), H)
    known = asof.known_covariates(ev_requests(spark, sf), covariates(spark, sf), H)
    cov = asof.covariate_cutoffs(known, H).withColumnRenamed("n_values_used", "n_cov")
    at = lambda lead: t.utc_text(F.try_element_at("last_valid_by_lead", F.lit(lead)))
    return used.join(cov, ["series_id", "issue_date"], "left").select(
        "series_id", "issue_date", utc("information_cutoff_utc").alias("information_cutoff_utc"), utc("first_value_used_utc").alias("first_value_used_utc"),
        utc("last_value_used_utc").alias("last_value_used_utc"), "n_values_used", utc("last_available_at_utc").alias("last_covariate_at_utc"),
        at(2).alias("lead_2_last_valid_utc"), at(3).alias("lead_3_last_valid_utc"), F.col("n_cov").cast("double").alias("n_covariates"),
    )


_CUT = "2024-01-18"


@query(
    "revision_tamper_check",
    q.with_(*q.ev_base())
    + f"SELECT series_id, model, h AS horizon_days, count(*) AS n_forecasts, CAST(0 AS BIGINT) AS n_changed FROM fc WHERE issue_date <= DATE '{_CUT}' GROUP BY ALL",
)
def revision_tamper_check(spark, sf):
    """Every value after the cutoff day is altered; forecasts issued until then must not move."""
    days = ev_days(spark, sf)
    altered = F.when(F.col("day") > _CUT, F.transform("values", lambda v: v * 3 + 700)).otherwise(F.col("values"))
    tampered = days.withColumn("values", altered)
    rows = lambda d: bands.forecast_rows(bt.naive_bands(d, CFG, BACKTEST_SPECS), CFG)
    keys = ["series_id", "model", "horizon_days", "issue_date", "target_date", "slot_utc"]
    diff = asof.tamper_differences(rows(days), rows(tampered), F.lit(_CUT).cast("date"), keys, ["q10", "q50", "q90"])
    return diff.groupBy("series_id", "model", "horizon_days").agg(
        F.count("*").alias("n_forecasts"), F.count(F.when(F.col("differs"), F.lit(1))).alias("n_changed")
    )
