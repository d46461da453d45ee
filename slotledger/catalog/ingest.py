"""Landed payloads, revisions, archives, gaps, exports. Payloads are built from the event table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotledger.bindings import panels as p
from slotledger.catalog import reports as rep
from slotledger.catalog import scores as sc
from slotledger.catalog import sql as q
from slotledger.catalog import windows as win
from slotledger.catalog.base import BACKTEST_SPECS, ev_bands, ev_days, ev_scores, ev_windows, query, r, utc
from slotledger.functions import arrays as a
from slotledger.functions import timecols as t
from slotledger.models.requests import forecast_requests
from slotledger.operators import asof, bands, summary
from slotledger.operators import observations as o
from slotledger.plans import backtest as bt
from slotledger.session import materialize, shared_folder
from slotledger.sources import archive, commits, exports, feeds, files, ledger
from slotledger.sources.commits import stored_schema
from slotledger.sources.versions import MonthArchive

H, Q = p.HOURLY, p.QUARTER
WEEK_S = 7 * 86400
WEEK_MS = WEEK_S * 1000


def hour_slots(spark, sf):
    return p.event_slots(spark, sf, H)


def price_chunks(spark, sf):
    """Weekly payloads per series, hours without events included as null."""
    days = p.event_days(spark, sf, H, fill=False)
    rows = o.unpack_days(days, H).withColumn("ms", F.unix_millis("slot_utc"))
    rows = rows.withColumn("chunk_start_ms", F.col("ms") - F.col("ms") % WEEK_MS)
    pair = F.array(F.col("ms").cast("double"), F.col("value"))
    chunk = rows.groupBy("series_id", "chunk_start_ms").agg(F.sort_array(F.collect_list(pair)).alias("series"))
    body = F.to_json(F.struct("series"), {"ignoreNullFields": "false"})
    return chunk.select("series_id", "chunk_start_ms", body.alias("payload"))


@query("parse_price_chunks", q.with_(q.ev_raw(3600)) + f"SELECT series_id, {q.utc_text('s')} AS slot, v AS value FROM raw")
def parse_price_chunks(spark, sf):
    rows = feeds.parse_price_chunks(price_chunks(spark, sf))
    return rows.select("series_id", utc("slot_utc").alias("slot"), "value")


@query(
    "range_scan_series",
    q.with_(q.ev_raw(3600)) + f"SELECT series_id, {q.utc_text('s')} AS slot, v AS value FROM raw WHERE s >= 1704844800 AND s < 1705708800",
)
def range_scan_series(spark, sf):
    """Ten days out of the chunks: chunks outside the range are not parsed."""
    start, end = F.lit(1704844800).cast("bigint"), F.lit(1705708800).cast("bigint")
    wanted = feeds.chunks_for_range(price_chunks(spark, sf), start * 1000, end * 1000)
    rows = feeds.parse_price_chunks(wanted).withColumn("ingested_at", F.timestamp_millis("chunk_start_ms"))
    hit = o.range_scan(rows.drop("chunk_start_ms"), F.timestamp_seconds(start), F.timestamp_seconds(end))
    return hit.select("series_id", utc("slot_utc").alias("slot"), "value")


@query(
    "parse_fallback_feed",
    q.with_(q.ev_raw(3600), f"x AS (SELECT *, CAST({q.local('s')} AS DATE) AS day FROM raw)")
    + f"SELECT series_id, {q.utc_text('s')} AS slot, v AS value FROM x WHERE day >= DATE '2024-01-10' AND day <= DATE '2024-01-20'",
)
def parse_fallback_feed(spark, sf):
    obs = hour_slots(spark, sf).withColumn("s", F.unix_seconds("slot_utc"))
    week = obs.withColumn("week", F.floor(F.col("s") / (7 * 86400)))
    packed = week.groupBy("series_id", "week").agg(F.sort_array(F.collect_list(F.struct("s", "value"))).alias("x"))
    body = F.to_json(F.struct(F.transform("x", lambda e: e["s"]).alias("unix_seconds"), F.transform("x", lambda e: e["value"]).alias("price")))
    payloads = packed.select("series_id", body.alias("payload"))
    rows = feeds.parse_fallback_feed(payloads, H, F.lit("2024-01-10").cast("date"), F.lit("2024-01-20").cast("date"))
    return rows.select("series_id", utc("slot_utc").alias("slot"), "value")


_REV_SQL = """rev AS (SELECT event_type AS series_id, (epoch_us(ts) // 1000000) // 3600 * 3600 AS s, round(value * 100) AS v, ts FROM events)"""


@query(
    "latest_wins_merge",
    q.with_(_REV_SQL)
    + f"SELECT series_id, {q.utc_text('s')} AS slot, arg_max(v, (ts, v)) AS value, count(*) AS revisions FROM rev GROUP BY series_id, s",
)
def latest_wins_merge(spark, sf):
    """Every event is a revision of its hour; archive and fresh halves merge, the newest wins."""
    ev = p.read(spark, sf, "events").select(
        F.col("event_type").alias("series_id"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("slot_utc"),
        F.round(F.col("value") * 100).alias("value"),
        F.col("ts").cast("timestamp").alias("ingested_at"),
    )
    half = F.lit("2024-01-15").cast("timestamp")
    merged = o.latest_wins_merge(ev.filter(F.col("ingested_at") < half), ev.filter(F.col("ingested_at") >= half))
    n = ev.groupBy("series_id", "slot_utc").agg(F.count("*").alias("revisions"))
    return merged.join(n, ["series_id", "slot_utc"]).select("series_id", utc("slot_utc").alias("slot"), "value", "revisions")


@query(
    "monthly_archive_upsert",
    q.with_(
        q.LI_RAW,
        f"m AS (SELECT *, strftime({q.local('s')}, '%Y-%m') AS month FROM raw)",
        f"""fresh AS (SELECT *, CASE WHEN month >= '2000-01' AND v > 90000 THEN v + 1 ELSE v END AS nv FROM m WHERE month >= '1999-06')""",
        "old AS (SELECT * FROM m WHERE month < '2001-01')",
    )
    + """SELECT month, count(*) FILTER (WHERE nv IS NOT NULL AND ov IS DISTINCT FROM nv) AS changed_rows, count(*) AS n_rows, sum(coalesce(nv, ov)) AS total
FROM (SELECT coalesce(f.month, o.month) AS month, f.nv, o.v AS ov FROM fresh f FULL JOIN old o ON o.series_id = f.series_id AND o.s = f.s) GROUP BY 1""",
)
def monthly_archive_upsert(spark, sf):
    """An archive written, a run that dies before its commit, a delivery merged, and every month as read back with the rows it changed."""
    obs = materialize(p.line_slots(spark, sf).withColumn("month", archive.local_month(F.col("slot_utc"), H)))
    revised = F.when((F.col("month") >= "2000-01") & (F.col("value") > 90000), F.col("value") + 1).otherwise(F.col("value"))
    fresh = obs.filter(F.col("month") >= "1999-06").withColumn("value", revised)
    kept = MonthArchive(spark, shared_folder(spark, "archive"), "series_id string, slot_utc timestamp, value double, month string", ["series_id", "slot_utc"], ["value"])
    kept.upsert(obs.filter(F.col("month") < "2001-01"))
    commits.write_run(fresh.withColumn("value", F.col("value") + 1000), kept.path, commits.new_run(), ["month"])
    changed = kept.upsert(fresh)
    held = kept.read().groupBy("month").agg(F.count("*").alias("n_rows"), F.sum("value").alias("total"))
    return held.join(changed, "month", "left").select("month", F.coalesce("changed_rows", F.lit(0)).alias("changed_rows"), "n_rows", "total")


_RAW60 = q.panel("ev60", fill=False)
_SPINE60 = [
    *_RAW60[:3],
    "sp AS (SELECT series_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM dd GROUP BY 1)",
    f"sb AS (SELECT series_id, day, {q.day_start('day')} AS d0, {q.day_start('day + 1')} AS d1 FROM sp)",
    "ss AS (SELECT series_id, day, unnest(range(d0, d1, 3600)) AS s FROM sb)",
    "sy AS (SELECT x.series_id, x.day, x.s, o.v FROM ss x LEFT JOIN obs o ON o.series_id = x.series_id AND o.s = x.s)",
]


def _spine(days):
    bounds = days.groupBy("series_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return o.day_spine(bounds, H)


@query(
    "incomplete_days",
    q.with_(*_SPINE60) + "SELECT series_id, day, CAST(count(*) AS INTEGER) AS n_slots, CAST(count(v) AS INTEGER) AS n_present FROM sy GROUP BY ALL HAVING count(v) < count(*)",
)
def incomplete_days(spark, sf):
    days = p.event_days(spark, sf, H, fill=False)
    return o.incomplete_days(days, _spine(days))


@query("day_is_complete", q.with_(*_SPINE60) + "SELECT series_id, day, count(v) = count(*) AS complete FROM sy GROUP BY ALL")
def day_is_complete(spark, sf):
    days = p.event_days(spark, sf, H, fill=False)
    return o.completeness(days, _spine(days)).select("series_id", "day", "complete")


_FALLBACK_SQL = [
    *_SPINE60,
    "fb AS (SELECT s, sum(v) AS fv FROM raw GROUP BY 1)",
    "gf AS (SELECT y.series_id, y.day, y.s, coalesce(y.v, f.fv) AS value, CASE WHEN y.v IS NULL AND f.fv IS NOT NULL THEN 1 ELSE 0 END AS filled FROM sy y LEFT JOIN fb f ON f.s = y.s)",
]


def gap_filled(spark, sf):
    """Hourly event series repaired from a second feed, the sum over all series of the hour."""
    obs = hour_slots(spark, sf)
    days = o.pack_days(obs, H)
    total = obs.groupBy("slot_utc").agg(F.sum("value").alias("value"))
    spine = _spine(days)
    second = o.pack_days(total.withColumn("series_id", F.lit("all")), H).drop("series_id").join(spine.select("series_id", "day"), "day")
    return o.fill_from_fallback(days, second, spine)


@query("gap_fill_from_fallback", q.with_(*_FALLBACK_SQL) + f"SELECT series_id, day, {q.utc_text('s')} AS slot, value, CAST(filled AS INTEGER) AS filled FROM gf")
def gap_fill_from_fallback(spark, sf):
    cells = F.arrays_zip(t.day_slots(F.col("day"), H).alias("slot"), F.col("values").alias("value"), "filled")
    rows = gap_filled(spark, sf).select("series_id", "day", F.inline(cells).alias("slot", "value", "filled"))
    return rows.withColumn("slot", utc("slot"))


@query(
    "fallback_log",
    q.with_(*_FALLBACK_SQL)
    + "SELECT series_id, '2024-02-01T09:00:00Z' AS fetched_at_utc, day AS delivery_date_local, CAST(sum(filled) AS BIGINT) AS slots_filled, 'second feed' AS source FROM gf GROUP BY series_id, day HAVING sum(filled) > 0",
)
def fallback_log(spark, sf):
    return o.fallback_log(gap_filled(spark, sf), F.lit("2024-02-01T09:00:00Z"), "second feed")


# Weather payloads: every event type is a location, hourly statistics of its events the variables.
_POINTS = (("click", True, False), ("error", True, True), ("purchase", False, True), ("signup", True, False), ("view", False, True))
_WX_SQL = [
    "pts(point, is_wind, is_solar) AS (VALUES ('click', true, false), ('error', true, true), ('purchase', false, true), ('signup', true, false), ('view', false, true))",
    """hx AS (SELECT event_type AS point, (epoch_us(ts) // 1000000) // 3600 * 3600 AS s, sum(CAST(round(value * 100) AS BIGINT)) AS c, count(*) AS n, max(CAST(round(value * 100) AS BIGINT)) AS mx FROM events GROUP BY ALL)""",
    "span AS (SELECT min(s) AS lo, max(s) AS hi FROM hx)",
    "grid AS (SELECT p.*, unnest(range(lo, hi + 1, 3600)) AS s FROM pts p, span)",
    """wx0 AS (SELECT g.point, g.is_wind, g.is_solar, g.s, l.lead,
    CASE WHEN l.lead = 2 THEN h.c / 1024.0::DOUBLE ELSE h.mx / 512.0::DOUBLE END AS wind, (h.n * 10 * l.lead)::DOUBLE AS solar, (h.mx - l.lead)::DOUBLE AS temp
  FROM grid g CROSS JOIN (VALUES (2), (3)) l(lead) LEFT JOIN hx h ON h.point = g.point AND h.s = g.s)""",
    "wx1 AS (SELECT *, lead(solar) OVER (PARTITION BY point, wx0.lead ORDER BY s) AS sol FROM wx0)",
    """wx AS (SELECT s, lead AS lead_days, avg(CASE WHEN is_wind THEN CASE WHEN wind > 25 THEN 0 WHEN wind IS NOT NULL THEN pow(least(greatest((wind - 3) / 9, 0), 1), 3) END END) AS wind_power,
    avg(CASE WHEN is_wind THEN wind END) AS wind_speed, avg(CASE WHEN is_solar THEN sol END) AS solar, avg(temp) AS temp, s - lead * 86400 + 6 * 3600 AS avail
  FROM wx1 GROUP BY ALL)""",
    "wxn AS (SELECT * FROM wx WHERE coalesce(wind_power, wind_speed, solar, temp) IS NOT NULL)",
]


def weather_payloads(spark, sf):
    """Weekly payloads per location, at most 169 hours each: a week and the hour after it."""
    ev = p.read(spark, sf, "events").select(
        F.col("event_type").alias("point"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )
    hourly = ev.groupBy("point", "h").agg(F.sum("cents").alias("c"), F.count("*").alias("n"), F.max("cents").alias("mx"))
    span = hourly.agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    points = hourly.select("point").distinct().crossJoin(F.broadcast(span))  # one row
    grid = points.select("point", F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("h")).join(hourly, ["point", "h"], "left")
    columns = {"wind_speed_100m_previous_day2": F.col("c") / 1024.0, "wind_speed_100m_previous_day3": F.col("mx") / 512.0}
    for lead in feeds.WEATHER_LEADS:
        columns[f"shortwave_radiation_previous_day{lead}"] = (F.col("n") * 10 * lead).cast("double")
        columns[f"temperature_2m_previous_day{lead}"] = (F.col("mx") - lead).cast("double")
    seconds = F.unix_seconds("h")
    week = F.floor(seconds / WEEK_S)
    # the first hour of a week also closes the chunk before it
    weeks = F.when(seconds % WEEK_S == 0, F.array(week - 1, week)).otherwise(F.array(week))
    rows = grid.select("point", F.explode(weeks).alias("week"), F.date_format("h", "yyyy-MM-dd'T'HH:mm").alias("time"), *[c.alias(n) for n, c in columns.items()])
    packed = rows.groupBy("point", "week").agg(F.sort_array(F.collect_list(F.struct("time", *columns))).alias("x"))
    fields = [a.field_of("x", n).alias(n) for n in ("time", *columns)]
    body = F.to_json(F.struct(F.struct(*fields).alias("hourly")), {"ignoreNullFields": "false"})
    until = F.timestamp_seconds((F.col("week") + 1) * WEEK_S)
    return packed.select(F.lit("nation").alias("series_id"), "point", until.alias("until_utc"), body.alias("payload"))


def event_weather(spark, sf):
    points = spark.createDataFrame(list(_POINTS), "point string, is_wind boolean, is_solar boolean")
    return feeds.aggregate_weather(weather_payloads(spark, sf), points, H)


@query(
    "aggregate_weather",
    q.with_(*_WX_SQL)
    + f"""SELECT {q.utc_text('s')} AS valid_utc, lead_days, {q.r('wind_power')} AS wind_power, {q.r('wind_speed')} AS wind_speed, {q.r('solar')} AS solar, {q.r('temp')} AS temp, {q.utc_text('avail')} AS available_at_utc FROM wxn""",
)
def aggregate_weather(spark, sf):
    w = event_weather(spark, sf)
    return w.select(utc("valid_utc").alias("valid_utc"), "lead_days", *[r(f).alias(f) for f in feeds.WEATHER_FEATURES], utc("available_at_utc").alias("available_at_utc"))


@query(
    "covariate_merge",
    q.with_(*_WX_SQL, "mg AS (SELECT s, lead_days, CASE WHEN s >= 1705276800 THEN temp + 1 ELSE temp END AS temp, wind_speed FROM wxn)")
    + f"""SELECT {q.utc_text('s')} AS valid_utc, lead_days, {q.re_('temp', 3)} AS temp, {q.re_('wind_speed', 3)} AS wind_speed FROM mg""",
)
def covariate_merge(spark, sf):
    """A second delivery from mid-month on with revised temperatures, merged into the month archive and read back; the newer row wins."""
    first = archive.normalize_covariates(event_weather(spark, sf)).withColumn("month", archive.local_month(F.col("valid_utc"), H))
    old = materialize(first)
    new = old.filter(F.unix_seconds("valid_utc") >= 1705276800).withColumn("temp", F.col("temp") + 1)
    schema = "series_id string, valid_utc timestamp, lead_days int, wind_power double, wind_speed double, solar double, temp double, available_at_utc timestamp, month string"
    kept = MonthArchive(spark, shared_folder(spark, "covariates"), schema, ["series_id", "valid_utc", "lead_days"], [*feeds.WEATHER_FEATURES, "available_at_utc"])
    kept.upsert(old)
    kept.upsert(new)
    return kept.read().select(utc("valid_utc").alias("valid_utc"), "lead_days", "temp", "wind_speed")


@query(
    "write_once_forecasts",
    q.with_(
        *q.panel("ev15"), *q.points("ev15"),
        "have AS (SELECT DISTINCT series_id, issue_date, model FROM pts)",
        "want AS (SELECT DISTINCT series_id, issue_date, model FROM req)",
    )
    + "SELECT w.series_id, w.issue_date, w.model FROM want w LEFT JOIN have h USING (series_id, issue_date, model) WHERE h.model IS NULL",
)
def write_once_forecasts(spark, sf):
    """What is still to be issued: due (issue, model) without any stored forecast."""
    from slotledger.models.naive import naive_points

    days = ev_days(spark, sf)
    targets = bt.targets_of(days, Q)
    due = forecast_requests(targets, BACKTEST_SPECS, Q).select(*ledger.MODEL_KEYS).distinct()
    return ledger.todo(due, naive_points(days, targets, Q, BACKTEST_SPECS)).drop("model_version")


@query(
    "write_once_ledger",
    q.with_(*q.ev_base())
    + f"""SELECT series_id, issue_date, model, h AS horizon_days, target_date, {q.utc_text('s')} AS slot,
  CASE WHEN issue_date < DATE '2024-01-20' THEN {q.r('q50', 3)} ELSE {q.r('q50 + 1000', 3)} END AS q50 FROM fc""",
)
def write_once_ledger(spark, sf):
    """Forecasts issued up to a day, then all issues once more with other values and a run that dies: what was issued first stays."""
    rows = materialize(bands.forecast_rows(ev_bands(spark, sf), Q))
    path = shared_folder(spark, "ledger")
    later = rows.withColumn("q50", F.col("q50") + 1000)
    ledger.issue_once(rows.filter(F.col("issue_date") < "2024-01-20"), path)
    commits.write_run(later, path, commits.new_run(), ["issue_date"])
    ledger.issue_once(later, path)
    held = ledger.read_ledger(spark, path, stored_schema(rows))
    return held.select("series_id", "issue_date", "model", "horizon_days", "target_date", utc("slot_utc").alias("slot"), r("q50", 3).alias("q50"))


def ev_manifests(spark, sf):
    """Manifests of the event panel, written and read back: counts and hashes from the forecasts' files, cutoffs of the values used."""
    days = ev_days(spark, sf)
    rows = bands.forecast_rows(ev_bands(spark, sf, days), Q)
    stored, written = shared_folder(spark, "forecasts"), shared_folder(spark, "manifests")
    files.write_forecasts(rows, stored, ["horizon_days", "slot_utc"])
    facts = files.forecast_facts(spark, stored, stored_schema(rows)).drop("path")
    issued = facts.join(rep.ev_issued(spark, sf), ["series_id", "issue_date"])
    cutoffs = asof.cutoff_metadata(days, facts.select("series_id", "issue_date").distinct(), Q)
    prices = files.cutoff_map(cutoffs, "prices", "observed values up to the end of the issue day")
    files.write_manifests(ledger.build_manifests(ev_windows(spark, sf, days), issued, prices, Q), written)
    return files.read_manifests(spark, written)


_MANIFEST_SQL = [
    *win.WIN, *q.bands(6), rep.ISSUED,
    "facts AS (SELECT series_id, issue_date, model, count(*) AS n_rows FROM fc GROUP BY ALL)",
    "used AS (SELECT k.series_id, k.issue_date, max(p.s) AS last_s, count(p.y) AS n_used FROM (SELECT DISTINCT series_id, issue_date FROM fc) k JOIN pan p ON p.series_id = k.series_id AND p.day <= k.issue_date GROUP BY ALL)",
    """mf AS (SELECT r.*, i.at_s, f.n_rows, u.last_s, u.n_used FROM rec r JOIN issued i ON i.series_id = r.series_id AND i.issue_date = r.issue_date
  JOIN facts f ON f.series_id = r.series_id AND f.issue_date = r.issue_date AND f.model = r.model JOIN used u ON u.series_id = r.series_id AND u.issue_date = r.issue_date)""",
]


@query(
    "read_manifests",
    q.with_(*_MANIFEST_SQL)
    + f"""SELECT series_id, issue_date, model, h AS horizon_days, target_date, {q.utc_text('at_s')} AS issued_at_utc, {q.utc_text('rec_s')} AS start_utc, {q.local_iso('rec_s')} AS start_local,
  {q.local_iso('end_s')} AS end_local, expected_mean, p_cheapest, p_near, n_rows, CAST(64 AS INTEGER) AS hash_length, {q.utc_text(q.day_start('issue_date + 1'))} AS information_cutoff_utc,
  {q.utc_text('last_s')} AS last_value_used_utc, n_used AS n_values_used FROM mf""",
)
def read_manifests(spark, sf):
    """Nested manifest files with the fixed schema, one row per recommended window, and what they state about their forecast."""
    manifests = materialize(ev_manifests(spark, sf))
    prices = F.col("data_cutoffs")["prices"]
    stated = manifests.select(
        *ledger.MODEL_KEYS, "n_rows", F.length("parquet_sha256").alias("hash_length"), prices["information_cutoff_utc"].alias("information_cutoff_utc"),
        prices["last_value_used_utc"].alias("last_value_used_utc"), prices["n_values_used"].alias("n_values_used"),
    )
    rows = ledger.manifest_windows(manifests).join(stated, ledger.MODEL_KEYS)
    return rows.select(
        "series_id", "issue_date", "model", "horizon_days", "target_date", "issued_at_utc", "start_utc", "start_local", "end_local", "expected_mean",
        "p_cheapest", "p_near", "n_rows", "hash_length", "information_cutoff_utc", "last_value_used_utc", "n_values_used",
    )


@query(
    "forecast_inventory",
    q.with_(
        *sc.SC, *q.windows(6, 12, Q.near_tolerance), rep.ISSUED,
        "mf AS (SELECT DISTINCT r.series_id, r.issue_date, r.model FROM rec r JOIN issued i ON i.series_id = r.series_id AND i.issue_date = r.issue_date)",
        "ms AS (SELECT DISTINCT series_id, model, horizon_days, target_date FROM sc WHERE status <> 'scored')",
    )
    + "SELECT count(*) AS forecast_files, count(DISTINCT issue_date) AS issue_days, min(issue_date) AS first_issue, max(issue_date) AS last_issue, (SELECT count(*) FROM ms) AS missed_forecasts FROM mf",
)
def forecast_inventory(spark, sf):
    return ledger.inventory(ev_manifests(spark, sf), summary.missed_list(ev_scores(spark, sf)))


@query(
    "bi_exports",
    q.with_(*q.ev_base())
    + f"""SELECT series_id, issue_date, model || '.v1' AS model_key, h AS horizon_days, target_date, {q.utc_text('s')} AS delivery_start_utc,
  strftime({q.local('s')}, '%Y-%m-%d') AS delivery_date_local, strftime({q.local('s')}, '%H:%M') AS delivery_time_local, printf('%.4f', q10) AS q10, printf('%.4f', q50) AS q50, printf('%.4f', q90) AS q90 FROM fc""",
)
def bi_exports(spark, sf):
    """Forecasts written as Parquet and CSV, the CSV as read back."""
    forecasts = exports.export_forecasts(bands.forecast_rows(ev_bands(spark, sf), Q), Q)
    return exports.write_export(forecasts, shared_folder(spark, "export"))[1]


@query(
    "export_actuals",
    q.with_(q.LI_RAW)
    + f"""SELECT series_id, {q.utc_text('s')} AS delivery_start_utc, strftime({q.local('s')}, '%Y-%m-%d') AS delivery_date_local, strftime({q.local('s')}, '%H:%M') AS delivery_time_local,
  printf('%.4f', v) AS price_eur_mwh FROM raw WHERE s >= {q.day_start("DATE '1998-10-01'")}""",
)
def export_actuals(spark, sf):
    """Actuals as CSV text from a local day on, across the autumn change."""
    since = t.day_start(F.lit("1998-10-01").cast("date"), H.tz)
    return exports.csv_text(exports.export_actuals(p.line_slots(spark, sf), H, since))


_TIMES = {"delivery_start_utc": "datetime", "delivery_date_local": "text", "delivery_time_local": "text"}
_HEAD = {"series_id": "text", "model_key": "text", "horizon_days": "integer", "issue_date": "date", "target_date": "date"}
_QUANTILES = dict.fromkeys(("q10", "q50", "q90"), "decimal")
_NUMBERS = dict.fromkeys(("actual_mean_recommended", "actual_mean_best", "actual_day_mean"), "decimal")
#: Columns and types of the exported tables, and the relation of the SQL counterpart that counts their values.
_EXPORTED = {
    "forecasts": ("fc", _HEAD | _TIMES | _QUANTILES),
    "actuals": ("pan", {"series_id": "text"} | _TIMES | {"price_eur_mwh": "decimal"}),
    "scores": ("sc", _HEAD | _TIMES | {"status": "text", "actual": "decimal"} | _QUANTILES | dict.fromkeys(("error", "abs_error", "sq_error", "pinball"), "decimal") | {"in_band": "true/false"}),
    "daily_scores": ("daily", _HEAD | {"status": "text"} | dict.fromkeys(("mae", "rmse", "pinball", "coverage_80"), "decimal") | {"n_slots": "integer"}),
    "cheapest_windows": ("rw", _HEAD | {"status": "text", "window_start_utc": "datetime"} | dict.fromkeys(("expected_mean", "p_cheapest", "p_near"), "decimal")
                         | {"actual_best_start_utc": "datetime"} | _NUMBERS | {"hit": "true/false", "near": "true/false", "regret": "decimal"}),
}
_COUNTED = {"price_eur_mwh": "y", "window_start_utc": "rec_s", "actual_best_start_utc": "best_s"}


def _dictionary_sql() -> str:
    rows = []
    for table, (relation, columns) in _EXPORTED.items():
        for c, kind in columns.items():
            known = "*" if c in _HEAD or c in _TIMES or c in ("status", "n_slots") else _COUNTED.get(c, c)
            unit, comment = (x.replace("'", "''") for x in exports.COMMENTS[c])
            rows.append(f"SELECT '{table}' AS \"table\", '{c}' AS \"column\", '{kind}' AS type, '{unit}' AS unit, '{comment}' AS description, count({known}) AS known_values FROM {relation}")
    names = {part.split(" AS ")[0].strip() for part in sc.SC}
    windows = [part for part in win.REAL if part.split(" AS ")[0].strip() not in names]
    return q.with_(*sc.SC, q.daily(), *windows) + " UNION ALL ".join(rows)


@query("data_dictionary", _dictionary_sql())
def data_dictionary(spark, sf):
    """What the five exported tables hold, from their files: types, units and comments travel with the columns."""
    days = ev_days(spark, sf)
    scored = materialize(ev_scores(spark, sf, days))
    tables = {
        "forecasts": exports.export_forecasts(bands.forecast_rows(ev_bands(spark, sf, days), Q), Q),
        "actuals": exports.export_actuals(o.unpack_days(days, Q), Q),
        "scores": exports.export_scores(scored, Q),
        "daily_scores": exports.export_daily(summary.daily_scores(scored)),
        "cheapest_windows": exports.export_windows(win.ev_realized(spark, sf, days)),
    }
    written = {name: exports.write_export(table, shared_folder(spark, "export"))[0] for name, table in tables.items()}
    return reduce(DataFrame.unionByName, [exports.data_dictionary(name, table) for name, table in written.items()])


@query(
    "latest_snapshot",
    q.with_(*win.WIN, *q.bands(6), "last AS (SELECT series_id, max(issue_date) AS issue_date FROM fc GROUP BY 1)")
    + f"""SELECT f.series_id, f.issue_date, f.model, f.h AS horizon_days, f.target_date, {q.utc_text('f.s')} AS start_utc, {q.local_iso('f.s')} AS start_local, {q.re_('f.q10', 2)} AS q10, {q.re_('f.q50', 2)} AS q50, {q.re_('f.q90', 2)} AS q90,
  {q.utc_text('r.rec_s')} AS window_start_utc, r.p_cheapest
FROM fc f JOIN last l ON l.series_id = f.series_id AND l.issue_date = f.issue_date LEFT JOIN rec r ON r.series_id = f.series_id AND r.model = f.model AND r.h = f.h AND r.target_date = f.target_date""",
)
def latest_snapshot(spark, sf):
    fc = bands.forecast_rows(ev_bands(spark, sf), Q)
    snap = exports.latest_snapshot(fc, ev_windows(spark, sf), Q)
    rows = snap.select("*", F.inline("quarter_hours"))
    return rows.select(
        "series_id", "issue_date", "model", "horizon_days", "target_date", "start_utc", "start_local", "q10", "q50", "q90",
        t.utc_text(F.col("cheapest_window.start_utc")).alias("window_start_utc"), F.col("cheapest_window.p_cheapest").alias("p_cheapest"),
    )


@query(
    "series_availability_log",
    f"""WITH fd(series_id) AS (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('residual')),
x AS (SELECT event_type AS series_id, max((epoch_us(ts) // 1000000) // 900 * 900) AS s FROM events WHERE ts <= TIMESTAMP '2024-01-20 06:45:00' GROUP BY 1)
SELECT '2024-01-20T06:45:00Z' AS probed_at_utc, fd.series_id, coalesce({q.utc_text('x.s')}, '') AS last_value_start_utc, coalesce({q.local_iso('x.s')}, '') AS last_value_start_local
FROM fd LEFT JOIN x USING (series_id)""",
)
def series_availability_log(spark, sf):
    """How far each feed reached at a probe; a feed that delivered nothing stays empty."""
    ev = p.read(spark, sf, "events").select(
        F.col("event_type").alias("series_id"), p._floor_slot(F.col("ts").cast("timestamp"), Q).alias("slot_utc"), "value",
        F.col("ts").cast("timestamp").alias("ingested_at"),
    )
    known = spark.createDataFrame([(s,) for s in ("click", "error", "purchase", "signup", "view", "residual")], "series_id string")
    return feeds.availability_log(ev, known, F.lit("2024-01-20 06:45:00").cast("timestamp"), Q)


