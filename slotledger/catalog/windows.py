"""Cheapest windows: means, scenarios, recommendations, outcomes and their summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotledger.bindings import panels as p
from slotledger.catalog import sql as q
from slotledger.catalog.base import BACKTEST_SPECS, ev_days, ev_windows, query, r, utc, yes_no
from slotledger.operators import summary
from slotledger.operators import windows as w
from slotledger.plans import backtest as bt

CFG = p.QUARTER
NEAR = CFG.near_tolerance
WIN = [*q.ev_base(False), *q.windows(6, 12, NEAR)]
REAL = [*WIN, q.scores()[0], *q.realized(12, NEAR)]


@query(
    "rolling_window_means",
    q.with_(
        *q.panel("li60"),
        """m0 AS (SELECT series_id, day, s, sum(y) OVER x / 3 AS mean, count(*) OVER x AS c
  FROM pan WINDOW x AS (PARTITION BY series_id, day ORDER BY s ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))""",
    )
    + f"SELECT series_id, day, {q.utc_text('s')} AS start_utc, {q.r('mean')} AS mean FROM m0 WHERE c = 3",
)
def rolling_window_means(spark, sf):
    """Every three-hour window of the hourly line panel, days with clock changes included."""
    rows = w.rolling_window_means(p.line_days(spark, sf), p.HOURLY)
    return rows.select("series_id", "day", utc("start_utc").alias("start_utc"), r("mean").alias("mean"))


@query(
    "scenario_curves",
    q.with_(*WIN)
    + f"""SELECT series_id, model, h AS horizon_days, target_date, {q.utc_text('s')} AS slot, count(*) AS n_scenarios, sum(x) AS total, min(x) AS lowest, max(x) AS highest
FROM scn1 GROUP BY ALL""",
)
def scenario_curves(spark, sf):
    """Spread of the scenario values per slot of every forecast."""
    curves = w.scenario_curves(bt.naive_errors(ev_days(spark, sf), CFG, BACKTEST_SPECS), CFG, [s.error_days for s in BACKTEST_SPECS])
    rows = w.scenario_rows(curves, CFG)
    return rows.groupBy("series_id", "model", "horizon_days", "target_date", utc("slot_utc").alias("slot")).agg(
        F.count("*").alias("n_scenarios"), F.sum("value").alias("total"), F.min("value").alias("lowest"), F.max("value").alias("highest")
    )


@query(
    "cheapest_window",
    q.with_(
        *WIN,
        """top3 AS (SELECT series_id, model, h, target_date, string_agg(strftime(timezone('UTC', to_timestamp(s)), '%H:%M'), ' ' ORDER BY rk) AS likeliest
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id, model, h, target_date ORDER BY p DESC, mean, s) AS rk FROM prob) WHERE rk <= 3 GROUP BY ALL)""",
    )
    + f"""SELECT r.series_id, r.model, r.h AS horizon_days, r.issue_date, r.target_date, {q.utc_text('r.rec_s')} AS start_utc, {q.utc_text('r.end_s')} AS end_utc,
  r.expected_mean, r.day_mean, r.p_cheapest, r.p_near, CAST(r.n_scenarios AS BIGINT) AS n_scenarios, t.likeliest
FROM rec r JOIN top3 t USING (series_id, model, h, target_date)""",
)
def cheapest_window(spark, sf):
    rows = ev_windows(spark, sf)
    likeliest = F.concat_ws(" ", F.transform("most_likely", lambda m: F.date_format(m["start_utc"], "HH:mm")))
    return rows.select(
        "series_id", "model", "horizon_days", "issue_date", "target_date", utc("start_utc").alias("start_utc"), utc("end_utc").alias("end_utc"),
        "expected_mean", "day_mean", "p_cheapest", "p_near", F.col("n_scenarios").cast("bigint").alias("n_scenarios"), likeliest.alias("likeliest"),
    )


def ev_realized(spark, sf, days=None):
    days = ev_days(spark, sf) if days is None else days
    due = bt.backtest_due(days, CFG, BACKTEST_SPECS)
    return w.realized_windows(due, ev_windows(spark, sf, days), days, CFG)


@query(
    "realized_window",
    q.with_(*REAL)
    + f"""SELECT series_id, model, horizon_days, issue_date, target_date, status, {q.local_iso('rec_s')} AS window_start_local, expected_mean, p_cheapest, p_near,
  {q.utc_text('best_s')} AS actual_best_start_utc, {q.r('actual_mean_recommended')} AS actual_mean_recommended, {q.r('actual_mean_best')} AS actual_mean_best,
  {q.r('actual_day_mean')} AS actual_day_mean, CAST(hit AS VARCHAR) AS hit, CAST(near AS VARCHAR) AS near, {q.r('regret')} AS regret FROM rw""",
)
def realized_window(spark, sf):
    x = ev_realized(spark, sf)
    return x.select(
        "series_id", "model", "horizon_days", "issue_date", "target_date", "status", "window_start_local", "expected_mean", "p_cheapest", "p_near",
        utc("actual_best_start_utc").alias("actual_best_start_utc"),
        *[r(c).alias(c) for c in ("actual_mean_recommended", "actual_mean_best", "actual_day_mean")],
        yes_no("hit").alias("hit"), yes_no("near").alias("near"), r("regret").alias("regret"),
    )


WINSUM = [
    *REAL,
    "rwk AS (SELECT *, model || '.v1' AS model_key FROM rw)",
    *q.tagged("rwk", "rww"),
    f"""ws AS (SELECT series_id, "window", model_key, horizon_days, count(*) AS days_due, count(CASE WHEN status = 'scored' THEN 1 END) AS days_scored,
    {q.r('avg(CAST(hit AS INTEGER))', 4)} AS hit_rate, {q.r("avg(CASE WHEN status = 'scored' THEN p_cheapest END)", 4)} AS mean_p_cheapest,
    {q.r("avg((p_cheapest - CAST(hit AS INTEGER)) * (p_cheapest - CAST(hit AS INTEGER)))", 4)} AS brier_cheapest,
    {q.r('avg(CAST(near AS INTEGER))', 4)} AS near_rate, {q.r("avg(CASE WHEN status = 'scored' THEN p_near END)", 4)} AS mean_p_near,
    {q.r("avg((p_near - CAST(near AS INTEGER)) * (p_near - CAST(near AS INTEGER)))", 4)} AS brier_near,
    {q.r('avg(regret)', 3)} AS mean_regret, {q.r('avg(actual_day_mean - actual_mean_recommended)', 3)} AS saving_vs_day_mean
  FROM rww GROUP BY ALL)""",
]
WS_COLUMNS = (
    'series_id, "window", model_key, horizon_days, days_due, days_scored, hit_rate, mean_p_cheapest, brier_cheapest, '
    "near_rate, mean_p_near, brier_near, mean_regret, saving_vs_day_mean"
)


def ev_window_summary(spark, sf):
    days = ev_days(spark, sf)
    latest = summary.latest_targets(days.withColumnRenamed("day", "target_date"))
    s = summary.window_summary(ev_realized(spark, sf, days), CFG, latest, rounded=False)
    rates = ("hit_rate", "mean_p_cheapest", "brier_cheapest", "near_rate", "mean_p_near", "brier_near")
    return s.select(
        "series_id", "window", "model_key", "horizon_days", "days_due", "days_scored",
        *[r(c, 4).alias(c) for c in rates], *[r(c, 3).alias(c) for c in ("mean_regret", "saving_vs_day_mean")],
    )


@query("window_summary", q.with_(*WINSUM) + f"SELECT {WS_COLUMNS} FROM ws")
def window_summary(spark, sf):
    return ev_window_summary(spark, sf)


