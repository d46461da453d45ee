"""Naive rules, error bands and issued forecasts."""

from __future__ import annotations



from pyspark.sql import functions as F

from slotledger.bindings import panels as p
from slotledger.catalog import sql as q
from slotledger.catalog.base import BACKTEST_SPECS, ev_bands, ev_days, query, r, utc
from slotledger.config import NAIVE_SPECS

from slotledger.functions import timecols as t
from slotledger.functions.losses import sort_quantiles
from slotledger.models import lasso
from slotledger.models.naive import naive_points
from slotledger.operators import bands as b
from slotledger.operators import shaping
from slotledger.plans import backtest as bt
from slotledger.plans import issue as issue_plan


def point_rows(points, cfg):
    cells = F.arrays_zip(t.day_slots(F.col("target_date"), cfg).alias("slot"), F.col("point").alias("q50"))
    return points.select(
        "series_id", "model", "horizon_days", "issue_date", "target_date", F.inline(cells).alias("slot", "q50")
    ).withColumn("slot", utc("slot"))


def _rule(name: str, model: str):
    """One naive rule on the hourly line panel, which covers thirteen clock changes."""
    spec = tuple(s for s in NAIVE_SPECS if s.name == model)

    @query(
        name,
        q.with_(*q.panel("li60"), *q.points("li60"))
        + f"""SELECT series_id, model, h AS horizon_days, issue_date, target_date, {q.utc_text('s')} AS slot, p AS q50
FROM pts WHERE model = '{model}'""",
    )
    def run(spark, sf, spec=spec):
        days = p.line_days(spark, sf)
        return point_rows(naive_points(days, bt.targets_of(days, p.HOURLY), p.HOURLY, spec), p.HOURLY)

    return run


_rule("naive_last_day", "naive_last_day")
_rule("naive_weekly", "naive_weekly")
_rule("naive_similar_day", "naive_similar_day")


@query(
    "profile_map",
    q.with_(*q.panel("ev60", fill=False), *q.points("ev60"))
    + f"""SELECT series_id, issue_date, target_date, {q.utc_text('s')} AS slot, p AS value
FROM pts WHERE model = 'naive_weekly' AND h = 1""",
)
def profile_map(spark, sf):
    """Weekly profiles of the hourly event panel with its gaps; thin source days drop out."""
    days = p.event_days(spark, sf, p.HOURLY, fill=False)
    targets = bt.targets_of(days, p.HOURLY).select(
        "series_id", "target_date", F.date_sub("target_date", 7).alias("source_day"), F.date_sub("target_date", 1).alias("issue_date")
    )
    laid = shaping.profile_map(targets, days, p.HOURLY)
    cells = F.arrays_zip(t.day_slots(F.col("target_date"), p.HOURLY).alias("slot"), F.col("point").alias("value"))
    return laid.select("series_id", "issue_date", "target_date", F.inline(cells).alias("slot", "value")).withColumn("slot", utc("slot"))


@query(
    "quantile_sort",
    """SELECT l_orderkey, l_linenumber, least(x, y, z) AS q10,
  x + y + z - least(x, y, z) - greatest(x, y, z) AS q50, greatest(x, y, z) AS q90,
  NOT (x <= y AND y <= z) AS crossed
FROM (SELECT l_orderkey, l_linenumber, l_quantity AS x, CAST(round(l_extendedprice / 1000) AS DOUBLE) AS y,
  CAST(round(l_tax * 1000) AS DOUBLE) AS z FROM lineitem)""",
)
def quantile_sort(spark, sf):
    """Three candidate values per line in ascending order, and whether they crossed."""
    x, y, z = F.col("l_quantity"), F.round(F.col("l_extendedprice") / 1000), F.round(F.col("l_tax") * 1000)
    lo, mid, hi = sort_quantiles(x, y, z)
    return p.read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", lo.alias("q10"), mid.alias("q50"), hi.alias("q90"), (~((x <= y) & (y <= z))).alias("crossed")
    )


@query(
    "past_errors",
    q.with_(*q.ev_base(False))
    + f"""SELECT series_id, model, h AS horizon_days, target_date, {q.utc_text('s')} AS slot, e AS error FROM err""",
)
def past_errors(spark, sf):
    """Error curve of every usable target day, recomputed from its own issue date."""
    err = bt.naive_errors(ev_days(spark, sf), p.QUARTER, BACKTEST_SPECS).filter(F.col("err").isNotNull())
    cells = F.arrays_zip(t.day_slots(F.col("target_date"), p.QUARTER).alias("slot"), F.col("err").alias("error"))
    return err.select("series_id", "model", "horizon_days", "target_date", F.inline(cells).alias("slot", "error")).withColumn("slot", utc("slot"))


@query(
    "hourly_error_quantiles",
    q.with_(*q.ev_base())
    + f"SELECT series_id, model, h AS horizon_days, target_date, hour, {q.r('e10')} AS e10, {q.r('e90')} AS e90 FROM eqs",
)
def hourly_error_quantiles(spark, sf):
    errors = bt.naive_errors(ev_days(spark, sf), p.QUARTER, BACKTEST_SPECS)
    eq = b.error_quantiles(errors, p.QUARTER, [s.error_days for s in BACKTEST_SPECS])
    rows = eq.select(
        "series_id", "model", "horizon_days", "target_date", F.posexplode(F.arrays_zip("e10", "e90")).alias("hour", "x")
    )
    return rows.select("series_id", "model", "horizon_days", "target_date", "hour", r(F.col("x.e10")).alias("e10"), r(F.col("x.e90")).alias("e90"))


@query(
    "apply_bands",
    q.with_(*q.ev_base())
    + f"""SELECT series_id, model, h AS horizon_days, issue_date, target_date, {q.utc_text('s')} AS slot,
  {q.r('q10')} AS q10, q50, {q.r('q90')} AS q90 FROM fc""",
)
def apply_bands(spark, sf):
    rows = b.forecast_rows(ev_bands(spark, sf), p.QUARTER)
    return rows.select(
        "series_id", "model", "horizon_days", "issue_date", "target_date", utc("slot_utc").alias("slot"),
        r("q10").alias("q10"), "q50", r("q90").alias("q90"),
    )


@query(
    "forecast_with_bands",
    q.with_(*q.panel("li60"), *q.points("li60"), *q.errors(90, 30), *q.bands(90))
    + f"""SELECT series_id, model, h AS horizon_days, issue_date, target_date, {q.utc_text('s')} AS slot,
  {q.r('q10')} AS q10, q50, {q.r('q90')} AS q90 FROM fc""",
)
def forecast_with_bands(spark, sf):
    """All rules with their standard 90-day error windows over the years of the line panel."""
    rows = b.forecast_rows(bt.naive_bands(p.line_days(spark, sf), p.HOURLY, NAIVE_SPECS), p.HOURLY)
    return rows.select(
        "series_id", "model", "horizon_days", "issue_date", "target_date", utc("slot_utc").alias("slot"),
        r("q10").alias("q10"), "q50", r("q90").alias("q90"),
    )


@query(
    "issue_forecasts",
    q.with_(*q.ev_base(), "last AS (SELECT series_id, max(day) AS issue_date FROM dd GROUP BY 1)")
    + f"""SELECT f.series_id, f.model, f.h AS horizon_days, f.issue_date, f.target_date, {q.utc_text('f.s')} AS slot,
  {q.local_iso('f.s')} AS slot_local, 'PT15M' AS resolution, {q.r('f.q10')} AS q10, f.q50, {q.r('f.q90')} AS q90
FROM fc f JOIN last l ON l.series_id = f.series_id AND l.issue_date = f.issue_date""",
)
def issue_forecasts(spark, sf):
    """The live run: both horizons of every rule for the latest issue day of each series."""
    table = p.event_day_table(spark, sf)
    issues = table.groupBy("series_id").agg(F.max("day").alias("issue_date"))
    first, last = issues.agg(F.min("issue_date"), F.max("issue_date")).first()
    days = p.between(table, first - issue_plan.look_back(BACKTEST_SPECS), last) if first else table.drop("month")
    rows = issue_plan.issue_naive(days, issues, p.QUARTER, BACKTEST_SPECS)
    return rows.select(
        "series_id", "model", "horizon_days", "issue_date", "target_date", utc("slot_utc").alias("slot"),
        t.local_iso(F.col("slot_utc"), p.QUARTER.tz).alias("slot_local"), F.lit(p.QUARTER.resolution).alias("resolution"),
        r("q10").alias("q10"), "q50", r("q90").alias("q90"),
    )


_CONFORMAL_SQL = q.with_(
    *q.ev_base(False),
    # raw quantiles: the point with a fixed margin
    """raw3 AS (SELECT series_id, model, h, issue_date, target_date, s, n, p - 2000.0::DOUBLE AS r10, p, p + 1000.0::DOUBLE AS r90 FROM pts)""",
    """gap AS (SELECT x.series_id, x.model, x.h, x.target_date, x.r10 - a.y AS lo, a.y - x.r90 AS hi
  FROM raw3 x JOIN pan a ON a.series_id = x.series_id AND a.day = x.target_date AND a.s = x.s)""",
    """cpool AS (SELECT n.series_id, n.model, n.h, n.issue_date, n.target_date, list(g.lo ORDER BY g.lo) AS lo, list(g.hi ORDER BY g.hi) AS hi
  FROM nerr n JOIN gap g ON g.series_id = n.series_id AND g.model = n.model AND g.h = n.h
   AND g.target_date <= n.issue_date AND g.target_date > n.issue_date - 6 GROUP BY ALL)""",
    f"""cshift AS (SELECT series_id, model, h, issue_date, target_date, {q.quantile('lo', 0.9)} AS c_lo, {q.quantile('hi', 0.9)} AS c_hi FROM cpool)""",
)


@query(
    "conformal_calibration",
    _CONFORMAL_SQL
    + f"""SELECT x.series_id, x.model, x.h AS horizon_days, x.target_date, {q.utc_text('x.s')} AS slot,
  {q.r('least(x.r10 - c.c_lo, x.p)')} AS q10, x.p AS q50, {q.r('greatest(x.r90 + c.c_hi, x.p)')} AS q90
FROM raw3 x JOIN cshift c USING (series_id, model, h, target_date)""",
)
def conformal_calibration(spark, sf):
    """Conformal shift of a fixed-margin band around every rule's point."""
    days = ev_days(spark, sf)
    points = naive_points(days, bt.targets_of(days, p.QUARTER), p.QUARTER, BACKTEST_SPECS)
    native = points.withColumn("raw10", F.transform("point", lambda x: x - 2000.0)).withColumn(
        "raw90", F.transform("point", lambda x: x + 1000.0)
    )
    out = b.conformal_bands(native, days, p.QUARTER, [s.error_days for s in BACKTEST_SPECS])
    rows = b.forecast_rows(out, p.QUARTER)
    return rows.select(
        "series_id", "model", "horizon_days", "target_date", utc("slot_utc").alias("slot"),
        r("q10").alias("q10"), "q50", r("q90").alias("q90"),
    )


_SCALE_SQL = q.with_(
    *q.panel("li60"),
    """hm AS (SELECT series_id, day, hour, avg(y) AS v FROM pan GROUP BY ALL)""",
    """med AS (SELECT series_id, hour, median(v) AS center FROM hm GROUP BY ALL)""",
    """dev AS (SELECT h.series_id, h.hour, m.center, median(abs(h.v - m.center)) / 0.6745::DOUBLE AS mad
  FROM hm h JOIN med m USING (series_id, hour) GROUP BY ALL)""",
    """sca AS (SELECT series_id, hour, center, CASE WHEN mad > 1e-9 THEN mad ELSE 1.0 END AS scale FROM dev)""",
)


@query(
    "robust_scale",
    _SCALE_SQL
    + f"""SELECT h.series_id, h.hour, count(*) AS n_days, {q.r('max(s.center)', 4)} AS center, {q.r('max(s.scale)', 4)} AS scale,
  {q.r('avg(asinh((h.v - s.center) / s.scale))', 5)} AS mean_asinh,
  {q.r('max(abs(sinh(asinh((h.v - s.center) / s.scale)) * s.scale + s.center - h.v))', 3)} AS worst_inverse
FROM hm h JOIN sca s USING (series_id, hour) GROUP BY ALL""",
)
def robust_scale(spark, sf):
    """Median/MAD scaling per hour of the line panel, the asinh transform and its inverse."""
    days = p.line_days(spark, sf).select("series_id", shaping.hour_means(p.HOURLY).alias("m"))
    rows = days.select("series_id", F.posexplode("m").alias("hour", "v")).filter(F.col("v").isNotNull())
    scale = shaping.robust_scale(rows, ["series_id", "hour"], "v")
    z = F.asinh((F.col("v") - F.col("center")) / F.col("scale"))
    back = F.sinh(z) * F.col("scale") + F.col("center")
    return rows.join(scale, ["series_id", "hour"]).groupBy("series_id", "hour").agg(
        F.count("*").alias("n_days"), r(F.max("center"), 4).alias("center"), r(F.max("scale"), 4).alias("scale"),
        r(F.avg(z), 5).alias("mean_asinh"), r(F.max(F.abs(back - F.col("v"))), 3).alias("worst_inverse"),
    )


_WINDOWS_SQL = ", ".join(f"({w})" for w in lasso.WINDOWS)


@query(
    "rolling_robust_scale",
    q.with_(
        *q.panel("li60"),
        """hm AS (SELECT series_id, day, hour, avg(y) AS v FROM pan GROUP BY ALL)""",
        f"""grid AS (SELECT CAST(unnest(generate_series(DATE '1970-01-04', hi, INTERVAL {lasso.REFIT_DAYS} DAY)) AS DATE) AS anchor FROM (SELECT max(day) + {max(lasso.WINDOWS)} AS hi FROM hm))""",
        f"""tr AS (SELECT h.series_id, h.hour, g.anchor, w.d AS window_days, h.v FROM hm h, grid g, (VALUES {_WINDOWS_SQL}) w(d)
  WHERE h.day <= g.anchor AND h.day > g.anchor - w.d AND h.v IS NOT NULL)""",
        """med AS (SELECT series_id, hour, anchor, window_days, count(*) AS n_values, median(v) AS center FROM tr GROUP BY ALL)""",
        """sca AS (SELECT m.series_id, m.hour, m.anchor, m.window_days, m.n_values, m.center, median(abs(t.v - m.center)) / 0.6745::DOUBLE AS mad
  FROM tr t JOIN med m ON m.series_id = t.series_id AND m.hour = t.hour AND m.anchor = t.anchor AND m.window_days = t.window_days GROUP BY ALL)""",
    )
    + f"""SELECT series_id, hour, anchor, window_days, n_values, {q.r('center', 4)} AS center, {q.r('CASE WHEN mad > 1e-9 THEN mad ELSE 1.0 END', 4)} AS scale FROM sca""",
)
def rolling_robust_scale(spark, sf):
    """Scale of every training window of the refit grid, per series and hour of the line panel."""
    days = p.line_days(spark, sf).select("series_id", "day", shaping.hour_means(p.HOURLY).alias("m"))
    rows = days.select("series_id", "day", F.posexplode("m").alias("hour", "v"))
    scale = shaping.rolling_scale(rows, ["series_id", "hour"], "day", "v", lasso.REFIT_DAYS, lasso.WINDOWS)
    return scale.select("series_id", "hour", "anchor", "window_days", "n_values", r("center", 4).alias("center"), r("scale", 4).alias("scale"))
