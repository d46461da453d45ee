"""Hourly matrices, lagged designs, intra-hour shapes and the pooled feature table."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotledger.bindings import panels as p
from slotledger.catalog import sql as q
from slotledger.catalog.base import ev_days, query, r, utc
from slotledger.functions import timecols as t
from slotledger.operators import features as feat
from slotledger.operators import shaping
from slotledger.sources.feeds import WEATHER_FEATURES

H, Q = p.HOURLY, p.QUARTER


def _hm(minimum: int, name: str = "hmx") -> list[str]:
    """Hourly matrix from ``pan``: filled within the day, thin days empty."""
    return [
        f"{name}_h AS (SELECT series_id, day, hour, avg(y) AS v FROM pan GROUP BY ALL)",
        f"{name}_g AS (SELECT d.series_id, d.day, CAST(t.hour AS INTEGER) AS hour, h.v, count(h.v) OVER (PARTITION BY d.series_id, d.day) AS nh FROM dd d CROSS JOIN range(24) t(hour) LEFT JOIN {name}_h h ON h.series_id = d.series_id AND h.day = d.day AND h.hour = t.hour)",
        f"""{name} AS (SELECT series_id, day, hour, CASE WHEN nh >= {minimum} THEN coalesce(v, last_value(v IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(v IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS v FROM {name}_g WINDOW w AS (PARTITION BY series_id, day ORDER BY hour))""",
    ]


def _index(name: str) -> str:
    return f"{name} AS (SELECT series_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM dd GROUP BY 1)"


@query(
    "hourly_matrix",
    q.with_(*q.panel("ev60", fill=False), *_hm(22), _index("ix"))
    + "SELECT i.series_id, i.day, CAST(t.hour AS INTEGER) AS hour, m.v AS value FROM ix i CROSS JOIN range(24) t(hour) LEFT JOIN hmx m ON m.series_id = i.series_id AND m.day = i.day AND m.hour = t.hour",
)
def hourly_matrix(spark, sf):
    """Event hours with their gaps: short gaps filled within the day, thin days left empty."""
    m = shaping.hourly_matrix(p.event_days(spark, sf, H, fill=False), H)
    empty = F.transform(F.sequence(F.lit(1), F.lit(24)), lambda _: F.lit(None).cast("double"))
    return m.select("series_id", "day", F.posexplode(F.coalesce("hours", empty)).alias("hour", "value"))


@query(
    "hourly_matrix_clock_changes",
    q.with_(*q.panel("li60"), *_hm(22)) + "SELECT series_id, day, hour, v AS value FROM hmx",
)
def hourly_matrix_clock_changes(spark, sf):
    """Line hours over all clock changes: doubled hours averaged, skipped ones filled."""
    m = shaping.hourly_matrix(p.line_days(spark, sf), H).filter(F.col("hours").isNotNull())
    return m.select("series_id", "day", F.posexplode("hours").alias("hour", "value"))


@query(
    "lag_features",
    q.with_(
        *q.panel("li60"), *_hm(22),
        "bb AS (SELECT series_id, min(day) AS lo, max(day) AS hi FROM dd GROUP BY 1)",
        "tt AS (SELECT b.series_id, CAST(unnest(generate_series(lo, hi + h.h, INTERVAL 1 DAY)) AS DATE) AS target_date, h.h FROM bb b, (VALUES (1), (2)) h(h))",
        """lg AS (SELECT t.series_id, t.target_date, t.h, g.pos, m.hour, m.v FROM tt t CROSS JOIN (VALUES (0, 0), (1, 1), (2, 2), (3, 7)) g(pos, k)
  LEFT JOIN hmx m ON m.series_id = t.series_id AND m.day = t.target_date - (CASE WHEN g.pos < 3 THEN t.h + g.k ELSE 7 END))""",
    )
    + """SELECT l.series_id, l.target_date, l.h AS horizon_days, l.target_date - l.h AS issue_date, count(l.v) = 96 AS complete, max(y.y_sum) AS y_sum,
  CASE WHEN count(l.v) = 96 THEN sum(l.v * (l.pos * 24 + l.hour + 1)) END AS x_digest
FROM lg l LEFT JOIN (SELECT series_id, day, sum(v * (hour + 1)) AS y_sum FROM hmx GROUP BY ALL) y ON y.series_id = l.series_id AND y.day = l.target_date
GROUP BY l.series_id, l.target_date, l.h""",
)
def lag_features(spark, sf):
    """Position-weighted sums stand for the 96 lagged and 24 target values of every row."""
    m = shaping.hourly_matrix(p.line_days(spark, sf), H)
    parts = [shaping.lag_features(m, h) for h in H.horizons]
    rows = parts[0].unionByName(parts[1])
    digest = lambda arr: F.aggregate(F.transform(arr, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return rows.select(
        "series_id", "target_date", "horizon_days", "issue_date", F.col("x_lags").isNotNull().alias("complete"), digest("y").alias("y_sum"), digest("x_lags").alias("x_digest")
    )


@query(
    "intra_hour_shape",
    q.with_(
        *q.panel("ev15"),
        "dv AS (SELECT series_id, day, clock, y - avg(y) OVER (PARTITION BY series_id, day, hour) AS dev FROM pan)",
    )
    + f"""SELECT i.series_id, i.day AS issue_date, CAST(left(d.clock, 2) AS INTEGER) * 4 + CAST(right(d.clock, 2) AS INTEGER) // 15 AS clock, {q.r('avg(d.dev)')} AS deviation
FROM dd i JOIN dv d ON d.series_id = i.series_id AND d.day <= i.day AND d.day > i.day - 28 GROUP BY ALL""",
)
def intra_hour_shape(spark, sf):
    s = shaping.intra_hour_shape(ev_days(spark, sf), Q)
    return s.select("series_id", "issue_date", "clock", r("deviation").alias("deviation"))


@query(
    "to_quarter_hours",
    q.with_(
        *q.panel("ev15"), *_hm(22), *q.points("ev15")[:1], *q.points("ev15")[2:5],
        "dv AS (SELECT series_id, day, clock, y - avg(y) OVER (PARTITION BY series_id, day, hour) AS dev FROM pan)",
        "shp AS (SELECT i.series_id, i.day AS issue_date, d.clock, avg(d.dev) AS dev FROM dd i JOIN dv d ON d.series_id = i.series_id AND d.day <= i.day AND d.day > i.day - 28 GROUP BY ALL)",
    )
    + f"""SELECT m.series_id, m.day AS issue_date, m.day + 1 AS target_date, {q.utc_text('c.s')} AS slot, {q.r('m.v + coalesce(s.dev, 0)')} AS value
FROM hmx m JOIN cal c ON c.target_date = m.day + 1 AND c.hour = m.hour LEFT JOIN shp s ON s.series_id = m.series_id AND s.issue_date = m.day AND s.clock = c.clock WHERE m.v IS NOT NULL""",
)
def to_quarter_hours(spark, sf):
    """Each day's hourly profile laid on the next day's quarter-hours with the usual shape."""
    days = ev_days(spark, sf)
    hourly = shaping.hourly_matrix(days, Q).filter(F.col("hours").isNotNull()).select(
        "series_id", F.col("day").alias("issue_date"), F.date_add("day", 1).alias("target_date"), F.col("hours").alias("hourly")
    )
    laid = shaping.to_slots(hourly, shaping.shape_vectors(shaping.intra_hour_shape(days, Q), Q), Q)
    cells = F.arrays_zip(t.day_slots(F.col("target_date"), Q).alias("slot"), F.col("hourly_slots").alias("value"))
    rows = laid.select("series_id", "issue_date", "target_date", F.inline(cells).alias("slot", "value"))
    return rows.select("series_id", "issue_date", "target_date", utc("slot").alias("slot"), r("value").alias("value"))


# Covariates of the line panel: quantity, discount and tax of the same hours as lead-time forecasts.
_LCOV_SQL = """lc AS (SELECT l_linestatus AS series_id, epoch_us(l_shipdate) // 1000000 + ((l_orderkey * 7 + l_linenumber * 5) % 24) * 3600 AS s, l.lead AS lead_days,
    (sum(CAST(l_quantity AS BIGINT)) % 32) / 32.0::DOUBLE AS wind_power, CAST(sum(CAST(l_quantity AS BIGINT)) + l.lead AS DOUBLE) AS wind_speed,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS solar, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) - 4 AS DOUBLE) AS temp
  FROM lineitem, (VALUES (2), (3)) l(lead) GROUP BY 1, 2, 3, l.lead)"""


def line_covariates(spark, sf):
    li = p.read(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("series_id"),
        F.timestamp_seconds(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 5) % 24) * 3600).alias("valid_utc"),
        F.col("l_quantity").cast("bigint").alias("qty"), F.round(F.col("l_discount") * 100).cast("bigint").alias("disc"), F.round(F.col("l_tax") * 100).cast("bigint").alias("tax"),
    )
    hourly = li.groupBy("series_id", "valid_utc").agg(F.sum("qty").alias("qty"), F.sum("disc").alias("disc"), F.sum("tax").alias("tax"))
    rows = hourly.withColumn("lead_days", F.explode(F.array(F.lit(2), F.lit(3))))
    return rows.select(
        "series_id", "valid_utc", "lead_days", ((F.col("qty") % 32) / 32.0).alias("wind_power"), (F.col("qty") + F.col("lead_days")).cast("double").alias("wind_speed"),
        F.col("disc").cast("double").alias("solar"), (F.col("tax") - 4).cast("double").alias("temp"),
    )


_CM_SQL = [
    _LCOV_SQL,
    f"lcl AS (SELECT *, CAST({q.local('s')} AS DATE) AS day, CAST(hour({q.local('s')}) AS INTEGER) AS hour FROM lc)",
    "lch AS (SELECT series_id, lead_days, day, hour, avg(wind_power) AS wind_power, avg(wind_speed) AS wind_speed, avg(solar) AS solar, avg(temp) AS temp FROM lcl GROUP BY ALL)",
    "lcg AS (SELECT d.series_id, d.lead_days, d.day, CAST(t.hour AS INTEGER) AS hour, h.wind_power, h.wind_speed, h.solar, h.temp FROM (SELECT DISTINCT series_id, lead_days, day FROM lch) d CROSS JOIN range(24) t(hour) LEFT JOIN lch h ON h.series_id = d.series_id AND h.lead_days = d.lead_days AND h.day = d.day AND h.hour = t.hour)",
    "cmx AS (SELECT series_id, lead_days, day, hour, "
    + ", ".join(
        f"coalesce({f}, last_value({f} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({f} IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {f}"
        for f in WEATHER_FEATURES
    )
    + " FROM lcg WINDOW w AS (PARTITION BY series_id, lead_days, day ORDER BY hour))",
]


@query(
    "covariate_matrix",
    q.with_(*_CM_SQL) + f"SELECT series_id, lead_days, day, hour, {', '.join(WEATHER_FEATURES)} FROM cmx",
)
def covariate_matrix(spark, sf):
    m = feat.covariate_matrix(line_covariates(spark, sf), H)
    return m.select("series_id", "lead_days", "day", F.posexplode(F.arrays_zip(*WEATHER_FEATURES)).alias("hour", "x")).select("series_id", "lead_days", "day", "hour", "x.*")


def _gbm_rows(h: int) -> list[str]:
    """tg, gx of one horizon."""
    return [
        f"tg{h} AS (SELECT DISTINCT d.series_id, CAST(d.day + k.k AS DATE) AS target_date FROM ix d, (VALUES (0), ({h}), ({h + 1}), (7)) k(k))",
        f"""gx{h} AS (SELECT t.series_id, {h} AS horizon_days, t.target_date, CAST(g.hour AS DOUBLE) AS hour, l1.v AS p_last_hour, l2.v AS p_last2_hour, l7.v AS p_week_hour, y.v AS price, c.wind_power, c.wind_speed, c.solar, c.temp,
    a.pm AS p_last_mean, a.pn AS p_last_min, a.px AS p_last_max, w.wk AS p_week_mean, n.wp AS wind_power_day, n.so AS solar_day, n.te AS temp_day, n.wp - o.wp AS wind_power_change, n.so - o.so AS solar_change,
    isodow(t.target_date) - 1 AS weekday, hd.d IS NOT NULL AS holiday
  FROM tg{h} t CROSS JOIN range(24) g(hour)
  LEFT JOIN hmx l1 ON l1.series_id = t.series_id AND l1.day = t.target_date - {h} AND l1.hour = g.hour
  LEFT JOIN hmx l2 ON l2.series_id = t.series_id AND l2.day = t.target_date - {h + 1} AND l2.hour = g.hour
  LEFT JOIN hmx l7 ON l7.series_id = t.series_id AND l7.day = t.target_date - 7 AND l7.hour = g.hour
  LEFT JOIN hmx y ON y.series_id = t.series_id AND y.day = t.target_date AND y.hour = g.hour
  LEFT JOIN cmx c ON c.series_id = t.series_id AND c.lead_days = {h + 1} AND c.day = t.target_date AND c.hour = g.hour
  LEFT JOIN pd a ON a.series_id = t.series_id AND a.day = t.target_date - {h}
  LEFT JOIN wm w ON w.series_id = t.series_id AND w.day = t.target_date - {h}
  LEFT JOIN cd n ON n.series_id = t.series_id AND n.lead_days = {h + 1} AND n.day = t.target_date
  LEFT JOIN cd o ON o.series_id = t.series_id AND o.lead_days = {h + 1} AND o.day = t.target_date - {h}
  LEFT JOIN hol hd ON hd.d = t.target_date)""",
    ]


def _gbm_sql() -> str:
    from slotledger.catalog.reports import HOLIDAYS_SQL

    return q.with_(
        *q.panel("li60"), *_hm(22), *_CM_SQL, HOLIDAYS_SQL,
        "pd AS (SELECT series_id, day, avg(v) AS pm, min(v) AS pn, max(v) AS px FROM hmx GROUP BY ALL)",
        _index("ix"),
        "wm AS (SELECT a.series_id, a.day, CASE WHEN count(b.pm) >= 5 THEN avg(b.pm) END AS wk FROM ix a JOIN pd b ON b.series_id = a.series_id AND b.day <= a.day AND b.day > a.day - 7 GROUP BY ALL)",
        "cd AS (SELECT series_id, lead_days, day, avg(wind_power) AS wp, avg(solar) AS so, avg(temp) AS te FROM cmx GROUP BY ALL)",
        *_gbm_rows(1), *_gbm_rows(2),
    ) + f"""SELECT series_id, horizon_days, target_date, hour, p_last_hour, p_last2_hour, p_week_hour, price, wind_power, wind_speed, solar, temp, {q.r('p_last_mean', 4)} AS p_last_mean, p_last_min, p_last_max, {q.r('p_week_mean', 4)} AS p_week_mean,
  {q.r('wind_power_day', 6)} AS wind_power_day, {q.r('solar_day', 6)} AS solar_day, {q.r('temp_day', 6)} AS temp_day, {q.r('wind_power_change', 6)} AS wind_power_change, {q.r('solar_change', 6)} AS solar_change,
  CAST(weekday AS DOUBLE) AS weekday, CAST(CAST(holiday AS INTEGER) AS DOUBLE) AS holiday, {q.r('price - p_week_mean', 4)} AS y FROM (FROM gx1 UNION ALL FROM gx2)"""


@query("gbm_features", _gbm_sql())
def gbm_features(spark, sf):
    """Feature table of the pooled tree model at both horizons over the line panel."""
    m = shaping.hourly_matrix(p.line_days(spark, sf), H)
    cov = feat.covariate_matrix(line_covariates(spark, sf), H)
    f = functools.reduce(DataFrame.unionByName, [feat.pooled_features(m, cov, h) for h in H.horizons])
    same = ["series_id", "horizon_days", "target_date", "hour", "p_last_hour", "p_last2_hour", "p_week_hour", "price", *WEATHER_FEATURES, "p_last_min", "p_last_max", "weekday", "holiday"]
    four = ["p_last_mean", "p_week_mean", "y"]
    six = ["wind_power_day", "solar_day", "temp_day", "wind_power_change", "solar_change"]
    return f.select(*same, *[r(c, 4).alias(c) for c in four], *[r(c).alias(c) for c in six])

