"""Ledger views: ranked metrics, headline, status per day, day cards, hints on bad days."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from slotledger.bindings import panels as p
from slotledger.catalog import scores as sc
from slotledger.catalog import sql as q
from slotledger.catalog import windows as win
from slotledger.catalog.base import ev_bands, ev_days, ev_scores, query, r
from slotledger.config import NAIVE_SPECS
from slotledger.operators import reports, summary
from slotledger.plans import backtest as bt

CFG = p.QUARTER
# Hints are judged on the event panel in hundredths and on the line panel in whole units.
HINTS = replace(p.HOURLY, level_jump=20000.0, bias_limit=10000.0)

RANKED = """SELECT series_id, "window", horizon_days, CAST(row_number() OVER (PARTITION BY series_id, "window", horizon_days
    ORDER BY model_key = 'naive_similar_day.v1' DESC, mae NULLS LAST, model_key) AS INTEGER) AS position, model_key,
  model_key = 'naive_similar_day.v1' AS is_reference, days_due, days_forecast, days_due - days_forecast AS missed, mae, rmse, skill_mae, pinball, coverage_80
FROM cube WHERE segment = 'all'"""


@query("metric_table_view", q.with_(*sc.CUBE) + RANKED)
def metric_table_view(spark, sf):
    return reports.metric_table(sc.ev_cube(spark, sf))


@query(
    "dm_verdicts",
    q.with_(*sc.SC, *sc.DM)
    + """SELECT series_id, "window", horizon_days, model_a, model_b, CASE WHEN p_value IS NULL THEN 'too_few_days'
  WHEN p_value < 0.05 THEN CASE WHEN statistic < 0 THEN model_a ELSE model_b END || ' better' ELSE 'no_significant_difference' END AS verdict FROM dm""",
)
def dm_verdicts(spark, sf):
    v = reports.dm_verdicts(sc.ev_tests(spark, sf))
    return v.select("series_id", "window", "horizon_days", "model_a", "model_b", "verdict")


@query(
    "headline",
    q.with_(
        *sc.CUBE, *sc.DM, *q.windows(6, 12, CFG.near_tolerance), *q.realized(12, CFG.near_tolerance), *win.WINSUM[len(win.REAL):],
        """dmr AS (SELECT series_id, horizon_days, CASE WHEN model_a = 'naive_similar_day.v1' THEN model_b ELSE model_a END AS model_key, statistic, p_value
  FROM dm WHERE "window" = 'all' AND (model_a = 'naive_similar_day.v1' OR model_b = 'naive_similar_day.v1'))""",
    )
    + """SELECT c.series_id, c.horizon_days, c.model_key, CAST(row_number() OVER (PARTITION BY c.series_id ORDER BY c.horizon_days, c.mae NULLS LAST, c.model_key) AS INTEGER) AS position,
  c.days_due, c.days_forecast, c.mae, c.skill_mae, d.statistic, d.p_value, w.hit_rate, w.near_rate, w.saving_vs_day_mean
FROM cube c LEFT JOIN dmr d ON d.series_id = c.series_id AND d.horizon_days = c.horizon_days AND d.model_key = c.model_key
LEFT JOIN ws w ON w.series_id = c.series_id AND w.horizon_days = c.horizon_days AND w.model_key = c.model_key AND w."window" = 'all'
WHERE c."window" = 'all' AND c.segment = 'all'""",
)
def headline(spark, sf):
    h = reports.headline(sc.ev_cube(spark, sf), sc.ev_tests(spark, sf), win.ev_window_summary(spark, sf))
    return h.select(
        "series_id", "horizon_days", "model_key", "position", "days_due", "days_forecast", "mae", "skill_mae", "statistic", "p_value",
        "hit_rate", "near_rate", "saving_vs_day_mean",
    )


def ev_issued(spark, sf):
    """Issue time of every forecast: the first event of the series at or after 08:45 that day."""
    from slotledger.functions import timecols as t

    ev = p.read(spark, sf, "events").select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"))
    ev = ev.filter(t.wall_clock(F.col("ts"), CFG.tz) >= CFG.earliest_issue)
    first = ev.groupBy("series_id", t.local_date(F.col("ts"), CFG.tz).alias("issue_date")).agg(F.min("ts").alias("issued_at_utc"))
    return first.withColumn("issued_at_utc", F.date_trunc("second", "issued_at_utc"))


ISSUED = f"""issued AS (SELECT series_id, issue_date, min(epoch_us(ts)) // 1000000 AS at_s FROM (
    SELECT event_type AS series_id, ts, timezone('{q.TZ}', timezone('UTC', ts)) AS lt, CAST(timezone('{q.TZ}', timezone('UTC', ts)) AS DATE) AS issue_date FROM events)
  WHERE strftime(lt, '%H:%M') >= '08:45' GROUP BY ALL)"""


@query(
    "status_ledger",
    q.with_(
        *sc.SC_LIVE, q.daily(), ISSUED,
        """gr AS (SELECT d.*, d.model || '.v1' AS model_key, min(target_date) OVER (PARTITION BY series_id) AS ft, max(target_date) OVER (PARTITION BY series_id) AS lt
  FROM due d WHERE h = 1)""",
        """cells AS (SELECT g.series_id, g.target_date, g.issue_date, CAST(g.target_date - g.ft + 1 AS INTEGER) AS entry, g.model_key,
    CASE WHEN y.status = 'scored' THEN printf('%.1f', round_even(y.mae, 1)) WHEN y.status IN ('missed', 'incomplete') THEN 'missed' ELSE 'pending' END AS cell
  FROM gr g LEFT JOIN daily y ON y.series_id = g.series_id AND y.model_key = g.model_key AND y.target_date = g.target_date AND y.horizon_days = 1
  WHERE g.target_date > g.lt - 14)""",
    )
    + f"""SELECT c.series_id, c.target_date, c.issue_date, c.entry,
  max(CASE WHEN model_key = 'naive_last_day.v1' THEN cell END) AS naive_last_day, max(CASE WHEN model_key = 'naive_weekly.v1' THEN cell END) AS naive_weekly,
  max(CASE WHEN model_key = 'naive_similar_day.v1' THEN cell END) AS naive_similar_day, max(strftime({q.local('i.at_s')}, '%H:%M')) AS issued_local
FROM cells c LEFT JOIN issued i ON i.series_id = c.series_id AND i.issue_date = c.issue_date GROUP BY ALL""",
)
def status_ledger(spark, sf):
    from slotledger.operators import scoring

    days = ev_days(spark, sf)
    due = scoring.due_grid(days.select("series_id", F.col("day").alias("target_date")), p.SHORT_SPECS, CFG)
    scores = scoring.score_vectors(due, ev_bands(spark, sf, days), days, CFG)
    made = ev_issued(spark, sf).crossJoin(
        F.broadcast(spark.createDataFrame([(s.name, s.version) for s in p.SHORT_SPECS], "model string, model_version string"))
    )
    keys = [s.key for s in p.SHORT_SPECS]
    out = reports.status_ledger(due, summary.daily_scores(scores), made, F.lit("2024-01-01").cast("date"), keys, CFG)
    return out.select("series_id", "target_date", "issue_date", "entry", *[F.col(f"`{k}`").alias(k[:-3]) for k in keys], "issued_local")


@query(
    "forecast_day_card",
    q.with_(
        *q.ev_base(),
        "pv AS (SELECT f.*, a.y FROM fc f LEFT JOIN pan a ON a.series_id = f.series_id AND a.day = f.target_date AND a.s = f.s)",
    )
    + f"""SELECT series_id, model || '.v1' AS model_key, h AS horizon_days, issue_date, target_date, {q.r('avg(q50)')} AS day_mean, min(q50) AS min,
  strftime({q.local('arg_min(s, (q50, s))')}, '%H:%M') AS min_at, max(q50) AS max, strftime({q.local('arg_min(s, (-q50, s))')}, '%H:%M') AS max_at,
  CASE WHEN count(y) = count(*) THEN {q.r('avg(abs(y - q50))')} END AS mae FROM pv GROUP BY series_id, model, h, issue_date, target_date""",
)
def forecast_day_card(spark, sf):
    days = ev_days(spark, sf)
    c = reports.forecast_day_card(ev_bands(spark, sf, days), days, CFG)
    return c.select("series_id", "model_key", "horizon_days", "issue_date", "target_date", r("day_mean").alias("day_mean"), "min", "min_at", "max", "max_at", r("mae").alias("mae"))


def hints_sql(kind: str, level: float, bias: float, slots: int, fc: str) -> list[str]:
    """diag: reasons and details per forecast; holidays come from a small calendar of rules."""
    return [
        "ds AS (SELECT series_id, day, count(*) AS n_slots, count(y) AS n_present, avg(y) AS mean, min(y) AS mn, max(y) AS mx, count(CASE WHEN y < 0 THEN 1 END) AS n_neg FROM pan GROUP BY ALL)",
        """dh AS (SELECT d.series_id, d.day, coalesce(sum(x.n_present), 0) AS hs, list(x.mx ORDER BY x.mx) FILTER (x.mx IS NOT NULL) AS am, list(x.mx - x.mn ORDER BY x.mx - x.mn) FILTER (x.mx IS NOT NULL) AS asp
  FROM ds d LEFT JOIN ds x ON x.series_id = d.series_id AND x.day < d.day AND x.day >= d.day - 90 GROUP BY ALL)""",
        f"""du AS (SELECT d.*, h.hs > {slots * 30} AS hist, {q.quantile('h.am', 0.95)} AS umax, {q.quantile('h.asp', 0.5)} AS uspr FROM ds d JOIN dh h USING (series_id, day))""",
        HOLIDAYS_SQL,
        f"""mb AS (SELECT f.series_id, f.model, f.h, f.issue_date, f.target_date, avg(f.q50 - a.y) AS bias, arg_min(f.s, (-abs(f.q50 - a.y), f.s)) AS ws
  FROM {fc} f JOIN pan a ON a.series_id = f.series_id AND a.day = f.target_date AND a.s = f.s GROUP BY ALL)""",
        f"""dg0 AS (SELECT m.series_id, m.model || '.v1' AS model_key, m.h AS horizon_days, m.target_date, u.n_neg, u.mean, b.mean AS mean_before, m.bias, m.ws,
    concat_ws(',', CASE WHEN abs(u.mean - b.mean) >= {level} THEN 'level_jump' END, CASE WHEN u.n_neg > 0 THEN 'negative' END,
      CASE WHEN u.hist AND u.mx > u.umax THEN 'spike' END, CASE WHEN u.hist AND u.mx - u.mn > 1.5 * u.uspr THEN 'spread' END,
      CASE WHEN h1.d IS NOT NULL THEN 'holiday' WHEN h0.d IS NOT NULL THEN 'after_holiday' END, CASE WHEN u.n_slots <> {slots} THEN 'clock_change' END) AS flags,
    CASE WHEN m.bias >= {bias} THEN 'bias_high' WHEN m.bias <= -{bias} THEN 'bias_low' END AS tilt
  FROM mb m JOIN du u ON u.series_id = m.series_id AND u.day = m.target_date LEFT JOIN ds b ON b.series_id = m.series_id AND b.day = m.issue_date
  LEFT JOIN hol h1 ON h1.d = m.target_date LEFT JOIN hol h0 ON h0.d = m.target_date - 1)""",
        f"""diag AS (SELECT g.series_id, g.model_key, g.horizon_days, g.target_date, concat_ws(',', CASE WHEN g.flags = '' THEN 'none' ELSE g.flags END, g.tilt) AS reasons,
    strftime({q.local('g.ws')}, '%H:%M') AS worst_at, f.q50 AS worst_forecast, a.y AS worst_actual, g.n_neg AS n_negative
  FROM dg0 g JOIN {fc} f ON f.series_id = g.series_id AND f.model || '.v1' = g.model_key AND f.h = g.horizon_days AND f.target_date = g.target_date AND f.s = g.ws
  JOIN pan a ON a.series_id = g.series_id AND a.s = g.ws)""",
    ]


# Easter Sunday by Gauss's rule with its two exceptions, then the fixed and movable holidays.
HOLIDAYS_SQL = """ea0 AS (SELECT y, y % 19 AS a, y % 4 AS b, y % 7 AS c, y // 100 AS k FROM range(1980, 2060) t(y)),
ea1 AS (SELECT *, (15 - (13 + 8 * k) // 25 + k - k // 4) % 30 AS mm, (4 + k - k // 4) % 7 AS nn FROM ea0),
ea2 AS (SELECT *, (19 * a + mm) % 30 AS d FROM ea1),
ea3 AS (SELECT *, (2 * b + 4 * c + 6 * d + nn) % 7 AS e FROM ea2),
easter AS (SELECT y, CAST(make_date(y, 3, 22) + CAST(CASE WHEN d = 29 AND e = 6 THEN 28 WHEN d = 28 AND e = 6 AND (11 * mm + 11) % 30 < 19 THEN 27 ELSE d END AS INTEGER) + CAST(e AS INTEGER) AS DATE) AS es FROM ea3),
hol0 AS (SELECT make_date(y, m, dd) AS d, nm, 1 AS pr FROM easter, (VALUES (1, 1, 'New Year''s Day'), (5, 1, 'Labor Day'), (10, 3, 'German Unity Day'), (12, 25, 'Christmas Day'), (12, 26, 'Second Day of Christmas')) f(m, dd, nm)
  WHERE NOT (m = 10 AND y < 1990) UNION ALL
  SELECT es + o, nm, 2 FROM easter, (VALUES (-2, 'Good Friday'), (1, 'Easter Monday'), (39, 'Ascension Day'), (50, 'Whit Monday')) v(o, nm) UNION ALL
  SELECT DATE '2017-10-31', 'Reformation Day', 1),
hol AS (SELECT CAST(d AS DATE) AS d, arg_min(nm, pr) AS name FROM hol0 GROUP BY 1)"""

LI_FC = [*q.panel("li60"), *q.points("li60"), *q.errors(90, 30), *q.bands(90)]
DIAG_COLUMNS = "series_id, model_key, horizon_days, target_date, reasons, worst_at, worst_forecast, worst_actual"


def _diag_columns(d):
    return d.withColumn("reasons", F.concat_ws(",", "reasons"))


@query(
    "miss_diagnostics",
    q.with_(
        *q.panel("li60"), *q.points("li60"), "pf AS (SELECT series_id, model, h, issue_date, target_date, s, p AS q50 FROM pts)",
        *hints_sql("li60", 20000.0, 10000.0, 24, "pf"),
    )
    + f"SELECT {DIAG_COLUMNS} FROM diag",
)
def miss_diagnostics(spark, sf):
    """Hints for every forecast of the line panel with its holidays and clock changes."""
    from slotledger.models.naive import naive_points

    days = p.line_days(spark, sf)
    points = naive_points(days, bt.targets_of(days, HINTS), HINTS, NAIVE_SPECS).withColumnRenamed("point", "q50")
    d = _diag_columns(reports.miss_diagnostics(days, points, HINTS))
    return d.select("series_id", "model_key", "horizon_days", "target_date", "reasons", "worst_at", "worst_forecast", "worst_actual")


@query(
    "failure_cards",
    q.with_(
        *sc.SC, q.daily(), *sc.FEATURED, *hints_sql("ev15", 25.0, 10.0, 96, "fc"),
        """cards AS (SELECT 'live' AS source, y.*, row_number() OVER (PARTITION BY y.series_id, y.model_key ORDER BY y.mae DESC, y.target_date) AS rk, 8 AS lim
  FROM daily y JOIN featured f ON f.series_id = y.series_id AND f.featured_model = y.model_key WHERE y.horizon_days = 1 AND y.status = 'scored' UNION ALL
  SELECT 'backtest', y.*, row_number() OVER (PARTITION BY y.series_id, y.model_key ORDER BY y.mae DESC, y.target_date), 4 FROM daily y WHERE y.horizon_days = 1 AND y.status = 'scored')""",
    )
    + f"""SELECT c.source, c.series_id, c.model_key, c.horizon_days, c.target_date, CAST(c.rk AS INTEGER) AS rank, {q.r('c.mae', 4)} AS mae, d.reasons, d.worst_at, d.worst_forecast, d.worst_actual
FROM cards c LEFT JOIN diag d USING (series_id, model_key, horizon_days, target_date) WHERE c.rk <= c.lim""",
)
def failure_cards(spark, sf):
    days = ev_days(spark, sf)
    daily = summary.daily_scores(ev_scores(spark, sf, days))
    hints = reports.miss_diagnostics(days, ev_bands(spark, sf, days), CFG)
    cards = _diag_columns(reports.failure_cards(daily, hints, CFG))
    return cards.select(
        "source", "series_id", "model_key", "horizon_days", "target_date", "rank", r("mae", 4).alias("mae"), "reasons", "worst_at",
        "worst_forecast", "worst_actual",
    )

