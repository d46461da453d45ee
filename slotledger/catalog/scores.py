"""Due forecasts, slot scores and their roll-ups over the replayed event panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotledger.bindings import panels as p
from slotledger.catalog import sql as q
from slotledger.catalog.base import ev_bands, ev_days, ev_scored_days, ev_scores, query, r, utc, yes_no
from slotledger.functions import losses
from slotledger.models.requests import model_key
from slotledger.operators import bands, scoring, summary
from slotledger.operators import observations as o
from slotledger.plans import backtest as bt

CFG = p.QUARTER
SC = [*q.ev_base(), *q.scores()]
SC_LIVE = [*q.ev_base(), *q.scores("2024-01-10")]


def ev_cube(spark, sf):
    """Metric cube of the replay, rounded for comparison."""
    days = ev_days(spark, sf)
    cube = summary.metric_cube(ev_scored_days(spark, sf, days), CFG, summary.observed_slots(days, CFG), rounded=False)
    exact = ["series_id", "window", "model_key", "horizon_days", "segment", "days_due", "days_forecast", "n_slots"]
    return cube.select(*exact, *[r(c, 3).alias(c) for c in ("mae", "rmse", "pinball", "coverage_80")], r("skill_mae", 4).alias("skill_mae"))


def ev_latest(days):
    return summary.latest_targets(days.withColumnRenamed("day", "target_date"))


def ev_tests(spark, sf):
    days = ev_days(spark, sf)
    daily = summary.daily_scores(ev_scores(spark, sf, days))
    tests = summary.diebold_mariano(daily, CFG, ev_latest(days), rounded=False)
    keys = ["series_id", "window", "horizon_days", "model_a", "model_b", "n_days"]
    return tests.select(*keys, r("statistic", 3).alias("statistic"), r("p_value", 4).alias("p_value"), r("mean_daily_mae_diff", 3).alias("mean_daily_mae_diff"))


@query(
    "due_grid",
    q.with_(*q.panel("ev15"), *q.scores("2024-01-10")[:1])
    + "SELECT series_id, model, h AS horizon_days, issue_date, target_date FROM due",
)
def due_grid(spark, sf):
    targets = ev_days(spark, sf).select("series_id", F.col("day").alias("target_date"))
    return scoring.due_grid(targets, p.SHORT_SPECS, CFG).drop("model_version")


_SLOT_SQL = f"""SELECT series_id, model, horizon_days, issue_date, target_date, {q.utc_text('s')} AS slot, status, actual,
  {q.r('q10')} AS q10, q50, {q.r('q90')} AS q90 FROM sc"""


def _slot_columns(sc):
    return sc.select(
        "series_id", "model", "horizon_days", "issue_date", "target_date", utc("slot_utc").alias("slot"), "status",
        "actual", r("q10").alias("q10"), "q50", r("q90").alias("q90"),
    )


@query("score_slots", q.with_(*SC_LIVE) + _SLOT_SQL)
def score_slots(spark, sf):
    """Stored forecast rows against actuals for everything due since the live start."""
    days = ev_days(spark, sf)
    due = scoring.due_grid(days.select("series_id", F.col("day").alias("target_date")), p.SHORT_SPECS, CFG)
    stored = bands.forecast_rows(ev_bands(spark, sf, days), CFG)
    return _slot_columns(scoring.score_slots(due, stored, days, CFG))


@query(
    "error_columns",
    q.with_(*SC)
    + f"""SELECT series_id, model, horizon_days, target_date, {q.utc_text('s')} AS slot, error, abs_error, sq_error,
  {q.r('pinball')} AS pinball, CAST(in_band AS VARCHAR) AS in_band FROM sc""",
)
def error_columns(spark, sf):
    return ev_scores(spark, sf).select(
        "series_id", "model", "horizon_days", "target_date", utc("slot_utc").alias("slot"), "error", "abs_error",
        "sq_error", r("pinball").alias("pinball"), yes_no("in_band").alias("in_band"),
    )


_P = lambda y, x, tau: f"greatest({tau!r}::DOUBLE * ({y} - {x}), {tau - 1.0!r}::DOUBLE * ({y} - {x}))"


@query(
    "pinball",
    f"""SELECT l_orderkey, l_linenumber, {q.r(_P('y', 'x', 0.1))} AS p10, {q.r(_P('y', 'x', 0.5))} AS p50, {q.r(_P('y', 'x', 0.9))} AS p90
FROM (SELECT l_orderkey, l_linenumber, l_quantity AS y, round(l_extendedprice / 1000) AS x FROM lineitem)""",
)
def pinball(spark, sf):
    y, x = F.col("l_quantity"), F.round(F.col("l_extendedprice") / 1000)
    return p.read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        *[r(losses.pinball(y, x, tau)).alias(n) for tau, n in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90"))],
    )


_NOW = "2024-01-26T10:30:00"  # before the local deadline of the day


@query(
    "scorable_days",
    q.with_(
        *q.panel("ev60", fill=False),
        "whole AS (SELECT series_id, day FROM pan GROUP BY ALL HAVING count(y) = count(*))",
        "done AS (SELECT series_id, min(day) + 9 AS upto FROM dd GROUP BY 1)",
    )
    + f"""SELECT f.series_id, f.day AS target_date FROM whole f JOIN done d USING (series_id)
WHERE f.day > d.upto AND epoch(TIMESTAMP '{_NOW}') >= {q.at_clock('f.day - 1', '12:00')}""",
)
def scorable_days(spark, sf):
    """Complete hourly days past their deadline and not among the first ten days scored before."""
    days = p.event_days(spark, sf, p.HOURLY, fill=False)
    spine = o.day_spine(_bounds(days), p.HOURLY)
    first = days.groupBy("series_id").agg(F.min("day").alias("lo"))
    scored = first.select("series_id", F.explode(F.sequence("lo", F.date_add("lo", 9))).alias("target_date"))
    return scoring.scorable_days(o.completeness(days, spine), scored, F.to_timestamp(F.lit(_NOW)), p.HOURLY)


def _bounds(days):
    return days.groupBy("series_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(
    "mae_rmse_coverage",
    q.with_(*SC)
    + f"""SELECT series_id, model_key, horizon_days, count(*) AS n_slots, {q.r('avg(abs_error)', 4)} AS mae,
  {q.r('sqrt(avg(sq_error))', 4)} AS rmse, {q.r('avg(pinball)', 4)} AS pinball, {q.r('avg(CAST(in_band AS INTEGER))', 4)} AS coverage_80
FROM sc WHERE status = 'scored' GROUP BY ALL""",
)
def mae_rmse_coverage(spark, sf):
    m = summary.headline_metrics(ev_scores(spark, sf))
    return m.select("series_id", "model_key", "horizon_days", "n_slots", *[r(c, 4).alias(c) for c in ("mae", "rmse", "pinball", "coverage_80")])


_PAIRED = """ref AS (SELECT series_id, horizon_days, s, abs_error AS ref_abs FROM sc WHERE model_key = 'naive_similar_day.v1' AND status = 'scored'),
pr AS (SELECT sc.*, ref.ref_abs FROM sc LEFT JOIN ref USING (series_id, horizon_days, s))"""


@query(
    "skill_vs_reference",
    q.with_(*SC, _PAIRED)
    + f"""SELECT series_id, model_key, horizon_days, count(*) AS n_paired,
  {q.r('1.0::DOUBLE - avg(abs_error) / nullif(avg(ref_abs), 0)')} AS skill_mae
FROM pr WHERE status = 'scored' AND ref_abs IS NOT NULL GROUP BY ALL""",
)
def skill_vs_reference(spark, sf):
    m = summary.skill_vs_reference(ev_scored_days(spark, sf))
    return m.select("series_id", "model_key", "horizon_days", "n_paired", r("skill_mae").alias("skill_mae"))


@query(
    "rolling_windows",
    q.with_(*SC, q.daily(), *q.tagged("daily", "dw"))
    + f"""SELECT series_id, "window", model_key, horizon_days, min(target_date) AS from_date, max(target_date) AS to_date,
  count(*) AS days, {q.r('avg(mae)', 4)} AS mean_daily_mae FROM dw WHERE status = 'scored' GROUP BY ALL""",
)
def rolling_windows(spark, sf):
    days = ev_days(spark, sf)
    d = summary.in_windows(summary.daily_scores(ev_scores(spark, sf, days)), CFG, ev_latest(days)).filter(summary.scored())
    return d.groupBy("series_id", "window", "model_key", "horizon_days").agg(
        F.min("target_date").alias("from_date"), F.max("target_date").alias("to_date"), F.count("*").alias("days"),
        r(F.avg("mae"), 4).alias("mean_daily_mae"),
    )


@query(
    "missed_list",
    q.with_(*SC) + "SELECT DISTINCT series_id, model_key, horizon_days, target_date, issue_date, status FROM sc WHERE status <> 'scored'",
)
def missed_list(spark, sf):
    return summary.missed_list(ev_scores(spark, sf))


_SPIKE = [
    "slots AS (SELECT DISTINCT series_id, target_date, s, actual FROM sc)",
    *q.tagged("slots", "slw"),
    'lst AS (SELECT series_id, "window", list(actual ORDER BY actual) AS a FROM slw GROUP BY ALL)',
    f'thr AS (SELECT series_id, "window", {q.quantile("a", 0.9)} AS spike_threshold FROM lst)',
]


@query(
    "spike_threshold",
    q.with_(*SC, *_SPIKE) + f'SELECT series_id, "window", {q.r("spike_threshold")} AS spike_threshold FROM thr',
)
def spike_threshold(spark, sf):
    thr = summary.spike_thresholds(summary.observed_slots(ev_days(spark, sf), CFG), CFG)
    return thr.select("series_id", "window", r("spike_threshold").alias("spike_threshold"))


_SEG = """CASE WHEN isodow(target_date) >= 6 THEN 'weekend' ELSE 'weekday' END"""


@query(
    "segments",
    q.with_(
        *SC, *_SPIKE,
        "x AS (SELECT sc.*, t.spike_threshold FROM sc JOIN thr t ON t.series_id = sc.series_id AND t.\"window\" = 'all')",
        f"""sg AS (SELECT *, 'all' AS segment FROM x UNION ALL SELECT *, {_SEG} FROM x
  UNION ALL SELECT *, 'negative_price' FROM x WHERE actual < 0
  UNION ALL SELECT *, 'price_spike' FROM x WHERE actual >= spike_threshold)""",
    )
    + """SELECT series_id, model_key, horizon_days, segment, count(*) AS n_rows, sum(actual) AS total FROM sg GROUP BY ALL""",
)
def segments(spark, sf):
    """Rows and total per segment; a slot counts in every segment it belongs to."""
    days = ev_days(spark, sf)
    thresholds = summary.spike_thresholds(summary.observed_slots(days, CFG), CFG)
    tagged = summary.segments_of(ev_scores(spark, sf, days), thresholds)
    return tagged.groupBy("series_id", model_key().alias("model_key"), "horizon_days", "segment").agg(
        F.count("*").alias("n_rows"), F.sum("actual").alias("total")
    )


CUBE = [
    *SC, *_SPIKE, _PAIRED,
    *q.tagged("pr", "pw"),
    'px AS (SELECT pw.*, t.spike_threshold FROM pw JOIN thr t USING (series_id, "window"))',
    f"""sg AS (SELECT *, 'all' AS segment FROM px UNION ALL SELECT *, {_SEG} FROM px
  UNION ALL SELECT *, 'negative_price' FROM px WHERE actual < 0
  UNION ALL SELECT *, 'price_spike' FROM px WHERE actual >= spike_threshold)""",
    """dues AS (SELECT series_id, "window", model_key, horizon_days, count(DISTINCT target_date) AS days_due,
    count(DISTINCT CASE WHEN status = 'scored' THEN target_date END) AS days_forecast FROM pw GROUP BY ALL)""",
    f"""mc AS (SELECT g.series_id, g."window", g.model_key, g.horizon_days, g.segment,
    count(CASE WHEN status = 'scored' THEN 1 END) AS n_slots,
    {q.r("avg(CASE WHEN status = 'scored' THEN abs_error END)", 3)} AS mae,
    {q.r("sqrt(avg(CASE WHEN status = 'scored' THEN sq_error END))", 3)} AS rmse,
    {q.r("avg(CASE WHEN status = 'scored' THEN pinball END)", 3)} AS pinball,
    {q.r("avg(CASE WHEN status = 'scored' THEN CAST(in_band AS INTEGER) END)", 3)} AS coverage_80,
    {q.r("1.0::DOUBLE - avg(CASE WHEN status = 'scored' AND ref_abs IS NOT NULL THEN abs_error END) / nullif(avg(CASE WHEN status = 'scored' THEN ref_abs END), 0)", 4)} AS skill_mae
  FROM sg g GROUP BY ALL)""",
]
CUBE_COLUMNS = 'series_id, "window", model_key, horizon_days, segment, days_due, days_forecast, n_slots, mae, rmse, pinball, coverage_80, skill_mae'
CUBE.append(f'cube AS (SELECT {CUBE_COLUMNS} FROM mc JOIN dues USING (series_id, "window", model_key, horizon_days))')


@query("metric_cube", q.with_(*CUBE) + f"SELECT {CUBE_COLUMNS} FROM cube")
def metric_cube(spark, sf):
    return ev_cube(spark, sf)


@query(
    "daily_scores",
    q.with_(*SC, q.daily())
    + f"""SELECT series_id, model_key, horizon_days, target_date, issue_date, status, {q.r('mae', 4)} AS mae, {q.r('rmse', 4)} AS rmse,
  {q.r('pinball', 4)} AS pinball, {q.r('coverage_80', 4)} AS coverage_80, n_slots FROM daily""",
)
def daily_scores(spark, sf):
    d = summary.daily_scores(ev_scores(spark, sf))
    return d.select(
        "series_id", "model_key", "horizon_days", "target_date", "issue_date", "status",
        *[r(c, 4).alias(c) for c in ("mae", "rmse", "pinball", "coverage_80")], "n_slots",
    )


def _dm_p(df: str, stat: str) -> str:
    """Two-sided t probability as a sum over the terms of the finite series."""
    th = f"atan(abs({stat}) / sqrt({df}::DOUBLE))"
    def terms(n: str, top: str, bottom: str) -> str:
        prod = f"list_product(list_transform(range(1, k + 1), lambda j: ({top}) / ({bottom})))"
        return f"coalesce(list_sum(list_transform(range(1, 1 + {n}), lambda k: {prod} * pow(cos({th}), 2 * k))), 0)"

    odd = f"(2 / pi() * ({th} + CASE WHEN {df} > 1 THEN sin({th}) * cos({th}) * (1 + {terms(f'({df} - 3) // 2', '2.0::DOUBLE * j', '2.0::DOUBLE * j + 1')}) ELSE 0 END))"
    even = f"(sin({th}) * (1 + {terms(f'({df} - 2) // 2', '2.0::DOUBLE * j - 1', '2.0::DOUBLE * j')}))"
    return f"(1 - CASE WHEN {df} % 2 = 1 THEN {odd} ELSE {even} END)"


DM = [
    q.daily(),
    """dmp AS (SELECT a.series_id, a.horizon_days, a.target_date, a.model_key AS model_a, b.model_key AS model_b, a.mae - b.mae AS d
  FROM daily a JOIN daily b ON a.series_id = b.series_id AND a.horizon_days = b.horizon_days AND a.target_date = b.target_date
   AND a.model_key < b.model_key AND a.status = 'scored' AND b.status = 'scored')""",
    """dml AS (SELECT series_id, max(target_date) AS latest FROM daily GROUP BY 1)""",
    """dmw AS (SELECT x.*, w.wname AS "window" FROM dmp x JOIN dml l USING (series_id),
    (VALUES ('7d', 7), ('30d', 30), ('90d', 90), ('all', 1000000)) w(wname, days)
  WHERE w.days = 1000000 OR x.target_date > l.latest - w.days)""",
    """dmc AS (SELECT *, d - avg(d) OVER (PARTITION BY series_id, "window", horizon_days, model_a, model_b) AS dc FROM dmw)""",
    """dmg AS (SELECT *, lag(dc) OVER (PARTITION BY series_id, "window", horizon_days, model_a, model_b ORDER BY target_date) AS l1 FROM dmc)""",
    """dms AS (SELECT series_id, "window", horizon_days, model_a, model_b, count(*) AS n, avg(d) AS mean_d,
    (sum(dc * dc) / count(*) + CASE WHEN horizon_days > 1 THEN 2.0::DOUBLE * coalesce(sum(dc * l1), 0) / count(*) ELSE 0 END) / count(*) AS var
  FROM dmg GROUP BY series_id, "window", horizon_days, model_a, model_b)""",
    """dmt AS (SELECT *, CASE WHEN n >= 10 AND var > 0 THEN mean_d / sqrt(var)
    * sqrt((n + 1 - 2 * horizon_days + horizon_days * (horizon_days - 1) / n::DOUBLE) / n) END AS stat FROM dms)""",
    f"""dm AS (SELECT series_id, "window", horizon_days, model_a, model_b, n AS n_days, {q.r('stat', 3)} AS statistic,
    {q.r('CASE WHEN stat IS NOT NULL THEN ' + _dm_p('(n - 1)', 'stat') + ' END', 4)} AS p_value,
    {q.r('CASE WHEN n >= 10 THEN mean_d END', 3)} AS mean_daily_mae_diff FROM dmt)""",
]


@query(
    "diebold_mariano",
    q.with_(*SC, *DM) + 'SELECT series_id, "window", horizon_days, model_a, model_b, n_days, statistic, p_value, mean_daily_mae_diff FROM dm',
)
def diebold_mariano(spark, sf):
    return ev_tests(spark, sf)


WORST = """worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, model_key, horizon_days ORDER BY mae DESC, target_date) AS rnk
  FROM daily WHERE status = 'scored') WHERE rnk <= 12)"""


@query(
    "worst_days",
    q.with_(*SC, q.daily(), WORST)
    + f"""SELECT w.series_id, w.model_key, w.horizon_days, w.target_date, CAST(w.rnk AS INTEGER) AS rank, {q.utc_text('s.s')} AS slot, s.actual, {q.r('s.q10')} AS q10, s.q50, {q.r('s.q90')} AS q90
FROM worst w JOIN sc s USING (series_id, model_key, horizon_days, target_date)""",
)
def worst_days(spark, sf):
    sc = ev_scores(spark, sf)
    w = summary.worst_day_slots(sc, summary.daily_scores(sc))
    return w.select("series_id", "model_key", "horizon_days", "target_date", "rank", utc("slot_utc").alias("slot"), "actual", r("q10").alias("q10"), "q50", r("q90").alias("q90"))


FEATURED = [
    """fl AS (SELECT series_id, max(target_date) AS latest FROM daily WHERE status = 'scored' AND horizon_days = 1 GROUP BY 1)""",
    """fm AS (SELECT series_id, model_key, avg(mae) AS m FROM daily JOIN fl USING (series_id)
  WHERE status = 'scored' AND horizon_days = 1 AND target_date > latest - 30
  GROUP BY ALL HAVING count(DISTINCT target_date) >= 14)""",
    """fb AS (SELECT series_id, arg_min(model_key, (m, model_key)) AS model_key FROM fm GROUP BY 1)""",
    """featured AS (SELECT s.series_id, coalesce(fb.model_key, 'naive_similar_day.v1') AS featured_model,
    CASE WHEN fb.model_key IS NULL THEN 'reference_until_enough_days' ELSE 'best_recent' END AS rule
  FROM (SELECT DISTINCT series_id FROM daily) s LEFT JOIN fb USING (series_id))""",
]


@query("featured_model", q.with_(*SC, q.daily(), *FEATURED) + "SELECT series_id, featured_model, rule FROM featured")
def featured_model(spark, sf):
    return summary.featured_model(summary.daily_scores(ev_scores(spark, sf)), CFG)


@query(
    "rolling_origin_backtest",
    q.with_(*q.panel("li60"), *q.points("li60"), *q.errors(90, 30), *q.bands(90), *q.scores(), q.daily())
    + f"""SELECT series_id, model_key, horizon_days, target_date, status, n_slots, {q.r('mae', 3)} AS mae, {q.r('rmse', 3)} AS rmse,
  {q.r('pinball', 3)} AS pinball, {q.r('coverage_80', 4)} AS coverage_80 FROM daily""",
)
def rolling_origin_backtest(spark, sf):
    """Replay of all rules over the years of the line panel, days without forecast included."""
    from slotledger.config import NAIVE_SPECS

    d = summary.daily_scores(bt.naive_backtest(p.line_days(spark, sf), p.HOURLY, NAIVE_SPECS))
    return d.select(
        "series_id", "model_key", "horizon_days", "target_date", "status", "n_slots",
        *[r(c, 3).alias(c) for c in ("mae", "rmse", "pinball")], r("coverage_80", 4).alias("coverage_80"),
    )


@query(
    "backtest_summary",
    q.with_(*CUBE)
    + """SELECT 'backtest' AS kind, c.series_id, b.first_target, b.last_target, "window", segment, model_key, horizon_days, n_slots, mae, rmse, pinball, coverage_80, skill_mae
FROM cube c JOIN (SELECT series_id, min(target_date) AS first_target, max(target_date) AS last_target FROM sc GROUP BY 1) b USING (series_id)""",
)
def backtest_summary(spark, sf):
    """Metrics of the replay, labelled so that they never mix with live rows."""
    targets = ev_days(spark, sf).withColumnRenamed("day", "target_date")
    return bt.labelled_summary(ev_cube(spark, sf), targets, "backtest").select(
        "kind", "series_id", "first_target", "last_target", "window", "segment", "model_key", "horizon_days",
        "n_slots", "mae", "rmse", "pinball", "coverage_80", "skill_mae",
    )


@query(
    "backtest_significance",
    q.with_(*SC, *DM)
    + """SELECT 'backtest' AS kind, d.series_id, b.first_target, b.last_target, "window", horizon_days, model_a, model_b, n_days, statistic, p_value, mean_daily_mae_diff
FROM dm d JOIN (SELECT series_id, min(target_date) AS first_target, max(target_date) AS last_target FROM sc GROUP BY 1) b USING (series_id)""",
)
def backtest_significance(spark, sf):
    """Paired tests of the replay, with the same labels as its metrics."""
    targets = ev_days(spark, sf).withColumnRenamed("day", "target_date")
    return bt.labelled_summary(ev_tests(spark, sf), targets, "backtest").select(
        "kind", "series_id", "first_target", "last_target", "window", "horizon_days", "model_a", "model_b", "n_days", "statistic", "p_value", "mean_daily_mae_diff"
    )


@query(
    "latest_backtest",
    q.with_(*q.panel("ev15"))
    + """SELECT series_id, max(strftime(lo, '%Y-%m-%d') || '_' || strftime(day, '%Y-%m-%d')) AS run_id
FROM (SELECT series_id, day, min(day) OVER (PARTITION BY series_id) AS lo FROM dd) GROUP BY 1""",
)
def latest_backtest(spark, sf):
    """Newest of the runs that end on each observed day."""
    days = ev_days(spark, sf).select("series_id", "day")
    lo = days.groupBy("series_id").agg(F.min("day").alias("lo"))
    runs = days.join(lo, "series_id").select(
        "series_id", F.concat_ws("_", F.date_format("lo", "yyyy-MM-dd"), F.date_format("day", "yyyy-MM-dd")).alias("run_id"), F.lit(True).alias("has_summary")
    )
    return bt.latest_run(runs)


