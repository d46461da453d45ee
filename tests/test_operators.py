"""Known values and properties of single operators, on small fixtures."""

import math
import tempfile
from dataclasses import replace
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotledger.config import NAIVE_SPECS, LedgerConfig
from slotledger.functions import timecols as t
from slotledger.functions.losses import pinball, wind_power
from slotledger.functions.quantiles import exact_quantile
from slotledger.functions.stats import t_two_sided
from slotledger.models import lasso
from slotledger.models.naive import source_day
from slotledger.operators import asof, bands, integrity, observations, scoring, shaping, summary, windows
from slotledger.plans import backtest, evaluate, issue
from slotledger.sources import archive, feeds, ledger
from slotledger.streaming.ingest import price_archive, stream_chunks

CFG = LedgerConfig()
SHORT = tuple(replace(s, error_days=6, min_error_days=4) for s in NAIVE_SPECS)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def day(text):
    return F.lit(text).cast("date")


def ts(text):
    return F.lit(text).cast("timestamp")


def synthetic_obs(spark, first, last, series="s"):
    """Daily shape plus noise over local days, one row per quarter-hour."""
    spine = spark.sql(f"select '{series}' as series_id, explode(sequence(date'{first}', date'{last}')) as day")
    slots = spine.select("series_id", F.explode(t.day_slots(F.col("day"), CFG)).alias("slot_utc"))
    # two humps by the minute of the local day, a weekday step and a repeatable jitter
    local = t.local_ts(F.col("slot_utc"), CFG.tz)
    minute = F.hour(local) * 60 + F.minute(local)
    humps = 25 * F.sin(minute / 1440 * 4 * math.pi) + 9 * F.cos(minute / 1440 * 2 * math.pi)
    jitter = F.pmod(F.xxhash64("slot_utc"), F.lit(701)) / 70.0
    value = 55 + humps + 3 * F.dayofweek(local) + jitter
    return slots.withColumn("value", F.round(value, 2))


# ---------------------------------------------------------------- time


@pytest.mark.parametrize(("d", "n"), [("2026-10-25", 100), ("2026-03-29", 92), ("2026-06-01", 96)])
def test_slots_of_a_local_day(spark, d, n):
    assert one(spark, F.size(t.day_slots(day(d), CFG))) == n
    assert one(spark, t.slots_in_day(day(d), CFG)) == n


def test_local_iso_tells_repeated_hours_apart(spark):
    assert one(spark, t.local_iso(ts("2025-10-26 00:30:00"), CFG.tz)) == "2025-10-26T02:30:00+02:00"
    assert one(spark, t.local_iso(ts("2025-10-26 01:30:00"), CFG.tz)) == "2025-10-26T02:30:00+01:00"


@pytest.mark.parametrize(
    ("utc", "ok"),
    [("2026-01-05 07:44:59", False), ("2026-01-05 07:45:00", True), ("2026-01-05 10:59:59", True), ("2026-01-05 11:00:00", False),
     ("2026-07-06 06:44:59", False), ("2026-07-06 06:45:00", True), ("2026-07-06 09:59:00", True), ("2026-07-06 10:00:00", False)],
)
def test_issue_window_in_winter_and_summer(spark, utc, ok):
    assert one(spark, t.in_issue_window(ts(utc), CFG)) is ok


# ---------------------------------------------------------------- scalars


def test_pinball_and_wind_power(spark):
    assert one(spark, pinball(F.lit(12.0), F.lit(10.0), 0.9)) == pytest.approx(1.8)
    assert one(spark, pinball(F.lit(8.0), F.lit(10.0), 0.9)) == pytest.approx(0.2)
    # below the cut-in speed, on the cubic branch, at rated speed, just before and after the cut-out
    assert [one(spark, wind_power(F.lit(v))) for v in (2.9, 12.0, 24.9, 25.1)] == [0.0, 1.0, 1.0, 0.0]
    assert one(spark, wind_power(F.lit(6.0))) < one(spark, wind_power(F.lit(9.0))) < 1.0


def test_t_probability(spark):
    # reference values of the t distribution: t=2 at 9 degrees, the Cauchy case, the normal limit
    assert one(spark, t_two_sided(F.lit(2.0), F.lit(9))) == pytest.approx(0.076552823771, abs=1e-11)
    assert one(spark, t_two_sided(F.lit(1.0), F.lit(1))) == pytest.approx(0.5, abs=1e-12)
    assert one(spark, t_two_sided(F.lit(-1.0), F.lit(2))) == pytest.approx(1 - 1 / math.sqrt(3), abs=1e-12)
    assert one(spark, t_two_sided(F.lit(1.96), F.lit(4000))) == pytest.approx(0.05, abs=1e-3)


def test_similar_day_rule(spark):
    asked = spark.sql("select explode(sequence(date'2026-06-01', date'2026-06-14')) as target").withColumn("issue", F.date_sub("target", 2))
    for r in asked.select("target", "issue", source_day(F.lit("similar_day"), F.col("issue"), F.col("target")).alias("src")).collect():
        week = r["target"].weekday() in (0, 5, 6)
        assert r["src"] == (r["target"] - timedelta(days=7) if week else r["issue"])


@pytest.mark.parametrize("q", [0.1, 0.5, 0.9])
def test_exact_quantile_equals_numpy_with_copies_and_one_huge_group(spark, q):
    rng = np.random.default_rng(3)
    groups = {"big": np.round(rng.normal(50, 400, 5000), 1), "flat": np.full(700, 7.0), "one": np.array([-3.25]), "mixed": np.r_[np.zeros(900), rng.random(100)]}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    out = exact_quantile(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", q, "x")
    for r in out.collect():
        assert r["x"] == pytest.approx(np.quantile(groups[r["k"]], q), abs=1e-9)


# ---------------------------------------------------------------- observations


def test_pack_and_unpack_keep_gaps_and_switch_days(spark):
    obs = synthetic_obs(spark, "2026-03-28", "2026-03-30").filter(F.col("slot_utc") != F.lit("2026-03-29 05:00:00").cast("timestamp"))
    days = observations.pack_days(obs, CFG)
    assert {(r["n_slots"], r["n_present"]) for r in days.collect()} == {(96, 96), (92, 91)}
    back = observations.unpack_days(days, CFG)
    assert back.count() == 96 + 92 + 96 and back.filter("value is null").count() == 1


def test_fallback_fills_only_gaps_and_never_overrides(spark):
    obs = synthetic_obs(spark, "2026-05-01", "2026-05-03")
    primary = observations.pack_days(obs.filter(F.hour("slot_utc") != 10), CFG)
    second = observations.pack_days(obs.withColumn("value", F.lit(-999.0)), CFG)
    spine = observations.day_spine(observations.day_bounds_of(obs, CFG), CFG)
    filled = observations.fill_from_fallback(primary, second, spine)
    assert [r["n_filled"] for r in filled.collect()] == [4, 4, 4]
    values = filled.select(F.explode("values").alias("v"))
    assert values.filter("v = -999").count() == 12
    # an empty second source leaves the gaps
    assert observations.fill_from_fallback(primary, second.limit(0), spine).agg(F.sum("n_filled")).first()[0] == 0


def test_profile_on_switch_days(spark):
    obs = synthetic_obs(spark, "2026-10-18", "2026-10-26")
    days = observations.pack_days(obs, CFG)
    ask = [("s", date(2026, 10, 25), date(2026, 10, 24), date(2026, 10, 24)), ("s", date(2026, 10, 26), date(2026, 10, 25), date(2026, 10, 25))]
    req = spark.createDataFrame(ask, "series_id string, target_date date, source_day date, issue_date date")
    out = {r["target_date"]: r for r in shaping.profile_map(req, days, CFG).collect()}
    src = {r["day"]: r["values"] for r in days.collect()}
    autumn = out[date(2026, 10, 25)]["point"]
    assert len(autumn) == 100 and autumn[8:12] == autumn[12:16] == src[date(2026, 10, 24)][8:12]
    after = out[date(2026, 10, 26)]["point"]
    both = [(x + y) / 2 for x, y in zip(src[date(2026, 10, 25)][8:12], src[date(2026, 10, 25)][12:16])]
    assert after[8:12] == pytest.approx(both)


# ---------------------------------------------------------------- bands and windows


@pytest.fixture(scope="module")
def panel(spark):
    obs = synthetic_obs(spark, "2026-05-01", "2026-05-28")
    return observations.pack_days(obs, CFG).persist()


def test_bands_equal_brute_force(spark, panel):
    banded = backtest.naive_bands(panel, CFG, SHORT[:1]).filter("target_date = date'2026-05-20' and horizon_days = 1").first()
    v = {r["day"]: np.array(r["values"]) for r in panel.collect()}
    d = date(2026, 5, 20)
    point = v[d - timedelta(days=1)]
    errs = np.array([v[x] - v[x - timedelta(days=1)] for x in (d - timedelta(days=k) for k in range(1, 7))])
    pooled = errs.reshape(6, 24, 4).transpose(1, 0, 2).reshape(24, -1)
    lo, hi = np.quantile(pooled, 0.1, axis=1).repeat(4), np.quantile(pooled, 0.9, axis=1).repeat(4)
    assert np.allclose(banded["q10"], np.minimum(point + lo, point))
    assert np.allclose(banded["q90"], np.maximum(point + hi, point))
    assert banded["n_error_days"] == 6


def test_blocks_do_not_change_bands(spark, panel, monkeypatch):
    base = backtest.naive_bands(panel, CFG, SHORT).select("model", "horizon_days", "target_date", "q10", "q90")
    want = {tuple(r[:3]): (r["q10"], r["q90"]) for r in base.collect()}
    monkeypatch.setattr(bands, "BLOCK_FACTOR", 1)
    got = backtest.naive_bands(panel, CFG, SHORT).select("model", "horizon_days", "target_date", "q10", "q90")
    assert {tuple(r[:3]): (r["q10"], r["q90"]) for r in got.collect()} == want


def test_flat_day_and_clear_valley(spark):
    flat, valley = [5.0] * 96, [50.0] * 40 + [1.0] * 12 + [50.0] * 44
    rows = [("s", date(2026, 6, 1), date(2026, 6, 2), x, [[0.0] * 96] * 5, n) for n, x in (("flat", flat), ("valley", valley))]
    df = spark.createDataFrame(rows, "series_id string, issue_date date, target_date date, point array<double>, past array<array<double>>, model string")
    df = df.select("*", F.lit("1").alias("model_version"), F.lit(1).alias("horizon_days"), F.lit(96).alias("n_slots"), F.sequence(F.lit(0), F.lit(95)).alias("clocks"))
    out = {r["model"]: r for r in windows.recommend_windows(df, CFG).collect()}
    assert out["flat"]["start_utc"] == datetime(2026, 6, 1, 22, 0) and out["flat"]["p_cheapest"] == 1.0
    assert out["valley"]["expected_mean"] == 1.0 and out["valley"]["start_utc"] == datetime(2026, 6, 2, 8, 0)
    assert out["valley"]["p_near"] == 1.0


def test_later_values_change_no_earlier_forecast(spark, panel):
    cut = date(2026, 5, 20)
    altered = panel.withColumn("values", F.when(F.col("day") > F.lit(cut), F.transform("values", lambda v: v * -7)).otherwise(F.col("values")))
    rows = lambda d: bands.forecast_rows(backtest.naive_bands(d, CFG, SHORT), CFG)
    keys = ["series_id", "model", "horizon_days", "target_date", "slot_utc"]
    before, after = (rows(x).withColumn("issue_date", F.date_sub("target_date", F.col("horizon_days"))) for x in (panel, altered))
    diff = asof.tamper_differences(before, after, F.lit(cut), keys, ["q10", "q50", "q90"])
    assert diff.count() > 0 and diff.filter("differs").count() == 0


def test_backtest_equals_live_issue(spark, panel):
    issues = spark.createDataFrame([("s", date(2026, 5, 22))], "series_id string, issue_date date")
    live = issue.issue_naive(panel, issues, CFG, SHORT)
    replay = bands.forecast_rows(backtest.naive_bands(panel, CFG, SHORT), CFG).filter("issue_date = date'2026-05-22'")
    assert live.count() == 3 * 2 * 96
    assert live.exceptAll(replay).count() == 0 and replay.exceptAll(live).count() == 0


def test_live_run_is_write_once_and_guarded(spark, panel):
    issues = spark.createDataFrame([("s", date(2026, 5, 22))], "series_id string, issue_date date")
    none = spark.createDataFrame([], "series_id string, issue_date date, model string, model_version string")
    known = observations.unpack_days(panel.filter("day <= date'2026-05-22'"), CFG)
    run = lambda fresh, have, at: issue.run_issue(panel, fresh, issues, have, ts(at), CFG, SHORT)
    made = run(known, none, "2026-05-22 07:00:00").persist()
    assert made.count() == 576
    assert run(known, made, "2026-05-22 07:00:00").count() == 0
    assert run(known, none, "2026-05-22 10:00:00").count() == 0  # deadline passed
    assert run(observations.unpack_days(panel, CFG), none, "2026-05-22 07:00:00").count() == 0  # next day visible


def test_scoring_is_idempotent_and_keeps_missed(spark, panel):
    specs = tuple(replace(s, live_since=date(2026, 5, 20)) for s in SHORT)
    stored = bands.forecast_rows(backtest.naive_bands(panel, CFG, specs), CFG).filter("not (model = 'naive_weekly' and issue_date = date'2026-05-22')").persist()
    nothing = spark.createDataFrame([], "series_id string, target_date date")
    now = ts("2026-05-27 12:00:00")
    scored = evaluate.new_scores(panel, stored, nothing, now, CFG, specs).persist()
    missed = scored.filter("status = 'missed'")
    assert {(r["model"], str(r["target_date"]), r["horizon_days"]) for r in missed.collect()} == {("naive_weekly", "2026-05-23", 1), ("naive_weekly", "2026-05-24", 2)}
    assert missed.filter("in_band is not null").count() == 0
    assert evaluate.new_scores(panel, stored, scored, now, CFG, specs).count() == 0
    tables = evaluate.summary_tables(scored, evaluate.new_window_scores(panel, backtest.naive_windows(panel, CFG, specs), nothing, now, CFG, specs), CFG)
    cube = tables["metrics"].filter("window = 'all' and segment = 'all' and model_key = 'naive_similar_day.v1'").collect()
    assert all(r["skill_mae"] == 0 for r in cube) and len(cube) == 2
    assert tables["dm_tests"].filter("p_value is not null").count() == 0  # fewer than ten days


def test_rolling_scale_equals_numpy(spark):
    rng = np.random.default_rng(5)
    start = date(1970, 1, 1)
    data = [("a", start + timedelta(int(d)), None if d % 9 == 0 else float(v)) for d, v in enumerate(rng.integers(-6, 7, 90))]
    data += [("a", start + timedelta(40), 100.0), ("flat", start + timedelta(3), 2.0), ("flat", start + timedelta(5), 2.0), ("none", start, None)]
    rows = spark.createDataFrame(data, "s string, day date, v double").repartition(5)
    got = {(r["s"], r["anchor"], r["window_days"]): (r["n_values"], r["center"], r["scale"]) for r in shaping.rolling_scale(rows, ["s"], "day", "v", 14, (7, 28)).collect()}
    want = {}
    for anchor in (date(1970, 1, 4) + timedelta(14 * k) for k in range(-2, 20)):
        for w in (7, 28):
            for s in ("a", "flat", "none"):
                x = np.array([v for k, d, v in data if k == s and v is not None and anchor - timedelta(w) < d <= anchor])
                if len(x):
                    mad = np.median(abs(x - np.median(x))) / 0.6745
                    want[s, anchor, w] = (len(x), np.median(x), mad if mad > 1e-9 else 1.0)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k] == pytest.approx(v) for k, v in want.items())
    assert shaping.rolling_scale(rows.limit(0), ["s"], "day", "v", 14, (7,)).count() == 0


def test_reference_errors_meet_by_slot(spark):
    """Scored, missed and incomplete models, a reference with other slots, and a day without a reference; compared with a plain loop."""
    key, ref = "series_id string, model string, model_version string, horizon_days int, issue_date date, target_date date, status string", "ref"
    vectors = "slots array<timestamp>, actual array<double>, q10 array<double>, q50 array<double>, q90 array<double>"
    slots = [datetime(2026, 1, 1, h) for h in range(4)]
    row = lambda m, d, status, at, y, q: ("s", m, "1", 1, date(2026, 1, d) - timedelta(1), date(2026, 1, d), status, at, y, q, q, q)
    none = [None] * 4
    rows = [
        row(ref, 1, "scored", slots, [1.0, 2.0, 3.0, 4.0], [2.0, 2.0, 1.0, 0.0]),
        row("a", 1, "scored", slots, [1.0, 2.0, 3.0, 4.0], [1.0, 1.0, 1.0, 1.0]),
        row("b", 1, "missed", slots, [1.0, 2.0, 3.0, 4.0], none),
        row(ref, 2, "scored", slots[1:], [5.0, 6.0, 7.0], [5.0, 5.0, 5.0]),
        row("a", 2, "scored", slots, [1.0, 5.0, 6.0, 7.0], [0.0, 0.0, 0.0, 0.0]),
        row(ref, 3, "incomplete", slots, [1.0, 1.0, 1.0, 1.0], [1.0, None, 1.0, 1.0]),
        row("a", 3, "scored", slots, [1.0, 1.0, 1.0, 1.0], [3.0, 3.0, 3.0, 3.0]),
    ]
    days = spark.createDataFrame(rows, f"{key}, {vectors}")
    want = {}
    for _, m, _, _, _, d, _, at, _, _, _, _ in rows:
        known = {s: abs(y - x) for r in rows if r[1] == ref and r[5] == d and r[6] == "scored" for s, y, x in zip(r[7], r[8], r[10], strict=True)}
        want |= {(m, d, s): known.get(s) for s in at}
    met = summary.with_reference(days, "ref.v1")
    assert {(r["model"], r["target_date"], r["slot_utc"]): r["ref_abs_error"] for r in met.collect()} == want
    plain = scoring.slots_of(days)
    assert sorted(map(str, scoring.slots_of(scoring.pack_scores(plain)).select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert "Window" not in met._jdf.queryExecution().executedPlan().toString()
    assert summary.metric_cube(days.limit(0), CFG).count() == 0


def test_conformal_coverage(spark, panel):
    points = backtest.naive_points(panel, backtest.targets_of(panel, CFG), CFG, SHORT[:1])
    native = points.withColumn("raw10", F.transform("point", lambda v: v - 0.5)).withColumn("raw90", F.transform("point", lambda v: v + 0.5))
    rows = bands.forecast_rows(bands.conformal_bands(native, panel, CFG, [6]), CFG)
    y = observations.unpack_days(panel, CFG).select("slot_utc", "value")
    cov = rows.join(y, "slot_utc").agg(F.avg(F.col("value").between(F.col("q10"), F.col("q90")).cast("double"))).first()[0]
    assert 0.74 < cov < 0.86


# ---------------------------------------------------------------- learned models


def test_lasso_recovers_a_sparse_rule_and_reads_nothing_after_the_anchor(spark):
    obs = synthetic_obs(spark, "2026-01-01", "2026-04-20")
    days = observations.pack_days(obs, CFG)
    anchor = date(2026, 4, 10)
    asked = spark.sql("select 's' as series_id, explode(sequence(date'2026-04-11', date'2026-04-14')) as target_date")
    run = lambda d: {(r["horizon_days"], r["target_date"]): r["point"] for r in lasso.lasso_points(d, asked, CFG, anchor, (28, 56), (0.01,)).collect()}
    got = run(days)
    assert set(got) == {(h, date(2026, 4, 10 + k)) for h in (1, 2) for k in range(h, 5)}
    actual = {r["day"]: r["values"] for r in days.collect()}
    errors = [abs(x - y) for (_, d), p in got.items() for x, y in zip(p, actual[d])]
    assert sum(errors) / len(errors) < 6
    # issues up to the day itself know nothing later: changing the future changes only what lags on it
    changed = observations.pack_days(obs.withColumn("value", F.when(F.col("slot_utc") >= ts("2026-04-11 22:00:00"), -500.0).otherwise(F.col("value"))), CFG)
    again = run(changed)
    for h, d in got:
        if (d - date(2026, 4, 11)).days <= h:
            assert again[h, d] == pytest.approx(got[h, d])


# ---------------------------------------------------------------- sources and integrity


def test_audit_finds_every_kind_of_violation(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    import hashlib
    import os

    def put(folder, name, data, manifest=True, issue="2026-05-22", at="2026-05-22T07:00:00Z", sha=None):
        os.makedirs(f"{root}/{folder}", exist_ok=True)
        if data is not None:
            open(f"{root}/{folder}/{name}.parquet", "wb").write(data)
        if manifest:
            digest = sha or hashlib.sha256(data or b"").hexdigest()
            open(f"{root}/{folder}/{name}.json", "w").write(
                '{"model": "m", "model_version": "1", "issue_date": "%s",\n "issued_at_utc": "%s", "parquet_sha256": "%s"}' % (issue, at, digest)
            )

    put("2026-05-22", "good", b"a")
    put("2026-05-22", "alone", b"b", manifest=False)
    put("2026-05-22", "gone", None)
    put("2026-05-22", "changed", b"c", sha="0" * 64)
    put("2026-05-23", "moved", b"d")
    put("2026-05-22", "late", b"e", at="2026-05-22T10:00:00Z")
    files = integrity.file_inventory(spark, root)
    manifests = ledger.read_manifest_files(spark, root).withColumnRenamed("file", "path")
    found = {(r["stem"].rsplit("/", 1)[1], r["violation"]) for r in integrity.manifest_audit(
        files.withColumn("path", F.regexp_replace("path", "^file:/+", "/")), manifests.withColumn("path", F.regexp_replace("path", "^file:/+", "/")), CFG).collect()}
    assert found == {("alone", "manifest missing"), ("gone", "file missing"), ("changed", "content changed"),
                     ("moved", "folder differs from issue date"), ("late", "issued outside the window")}
    snapshot = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/inventory"
    files.write.parquet(snapshot)
    open(f"{root}/2026-05-22/good.parquet", "wb").write(b"tampered")
    os.remove(f"{root}/2026-05-22/late.parquet")
    diff = integrity.immutability_diff(spark.read.parquet(snapshot), integrity.file_inventory(spark, root))
    assert {(r["path"].rsplit("/", 1)[1], r["change"]) for r in diff.collect()} == {("good.parquet", "M"), ("late.parquet", "D")}


def test_stream_merges_revisions(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    landing = root + "/landing"
    chunk = lambda v, at: spark.createDataFrame([("s", '{"series":[[1767225600000,%s],[1767226500000,null]]}' % v, at)], "series_id string, payload string, ingested_at string")
    for value, at in ((10.0, "2026-01-01T00:00:00Z"), (12.5, "2026-01-02T00:00:00Z")):
        chunk(value, at).coalesce(1).write.mode("append").json(landing)
        stream_chunks(spark, landing, root + "/archive", root + "/ckpt", CFG).awaitTermination(120)
    assert [(r["value"], r["month"]) for r in price_archive(spark, root + "/archive").read().collect()] == [(12.5, "2026-01")]


def test_weather_aggregate_skips_missing_points(spark):
    body = lambda v: '{"hourly": {"time": ["2026-01-01T00:00", "2026-01-01T01:00"], "wind_speed_100m_previous_day2": [%s, null], "shortwave_radiation_previous_day2": [1, 5], "temperature_2m_previous_day2": [2, null]}}' % v
    df = spark.createDataFrame([("n", "a", body(12)), ("n", "b", body("null"))], "series_id string, point string, payload string")
    points = spark.createDataFrame([("a", True, True), ("b", True, False)], "point string, is_wind boolean, is_solar boolean")
    rows = {r["valid_utc"].hour: r for r in feeds.aggregate_weather(df, points, CFG).collect()}
    assert set(rows) == {0}  # the second hour has no feature left once radiation moved an hour earlier
    assert (rows[0]["wind_power"], rows[0]["wind_speed"], rows[0]["solar"], rows[0]["temp"]) == (1.0, 12.0, 5.0, 2.0)
    assert rows[0]["available_at_utc"] == datetime(2025, 12, 30, 6, 0)


def test_weather_chunks_equal_the_whole_history(spark):
    """A chunk carries the hour after its end for the shift of radiation, and that hour is not told twice."""
    import json

    hours = [f"2026-01-01T{h:02d}:00" for h in range(8)]
    body = lambda k: json.dumps({"hourly": {"time": [hours[i] for i in k], **{f"{v}_previous_day{n}": [float(i * n) for i in k] for v in feeds.WEATHER_VARIABLES for n in feeds.WEATHER_LEADS}}})
    points = spark.createDataFrame([("a", True, True)], "point string, is_wind boolean, is_solar boolean")
    whole = spark.createDataFrame([("n", "a", body(range(8)))], "series_id string, point string, payload string")
    ends = [datetime(2026, 1, 1, 3), datetime(2026, 1, 1, 6), datetime(2026, 1, 1, 9)]
    chunks = spark.createDataFrame([("n", "a", e, body(range(3 * i, min(3 * i + 4, 8)))) for i, e in enumerate(ends)], "series_id string, point string, until_utc timestamp, payload string")
    rows = lambda df: sorted(map(tuple, feeds.aggregate_weather(df, points, CFG).collect()))
    assert rows(chunks) == rows(whole) and len(rows(whole)) == 16
