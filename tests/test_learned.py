"""Learned models: refits, boosting, refusals, leaks, and the replay that equals live runs."""

import math
from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from slotledger.config import LedgerConfig
from slotledger.functions import timecols as t
from slotledger.models import boosting, lasso, refits
from slotledger.operators import observations, scoring, shaping, summary
from slotledger.operators.features import FEATURE_COLUMNS
from slotledger.plans import backtest
from slotledger.session import materialize
from slotledger.sources import feeds

HOURLY = LedgerConfig(slot_minutes=60)
SMALL = boosting.BoostingSize(stages=4, rate=0.5, depth=3, min_leaf=20)
FIRST, LAST = date(2026, 1, 1), date(2026, 7, 30)


def hourly_panel(spark, first=FIRST, last=LAST):
    """A daily shape that wind lowers, and a jitter."""
    spine = spark.sql(f"select 's' as series_id, explode(sequence(date'{first}', date'{last}')) as day")
    slots = spine.select("series_id", F.explode(t.day_slots(F.col("day"), HOURLY)).alias("slot_utc"))
    hour = F.hour(t.local_ts(F.col("slot_utc"), HOURLY.tz))
    value = 60 + 20 * F.sin(hour / 24 * 2 * math.pi) - 30 * wind() + F.pmod(F.xxhash64("slot_utc"), F.lit(997)) / 100.0
    return slots.withColumn("value", F.round(value, 3))


def wind():
    return F.pmod(F.xxhash64(F.lit("wind"), F.date_trunc("day", "slot_utc")), F.lit(101)) / 100.0


def weather(slots):
    rows = slots.withColumn("lead_days", F.explode(F.array(F.lit(2), F.lit(3)))).withColumn("wind_power", wind())
    rows = rows.select("series_id", F.col("slot_utc").alias("valid_utc"), "lead_days", "wind_power", (F.col("wind_power") * 10).alias("wind_speed"), F.lit(1.0).alias("solar"), F.lit(2.0).alias("temp"))
    return rows.withColumn("available_at_utc", feeds.available_at(HOURLY))


@pytest.fixture(scope="module")
def panel(spark):
    slots = hourly_panel(spark).persist()
    return slots, weather(slots).persist()


def packed(slots):
    return observations.pack_days(slots, HOURLY)


def points_of(slots, covariates, targets, every=28, size=SMALL):
    asked = slots.sparkSession.createDataFrame([("s", d) for d in targets], "series_id string, target_date date")
    rows = boosting.boosted_points(packed(slots), covariates, asked, HOURLY, every, size).collect()
    return {(r["horizon_days"], r["target_date"]): (r["raw10"], r["point"], r["raw90"]) for r in rows}


def test_anchors_are_sundays_on_one_grid(spark):
    for every in (7, 364):
        got = refits.anchors_between(date(2025, 3, 5), date(2026, 5, 1), every)
        assert all(a.weekday() == 6 for a in got) and got[0] <= date(2025, 3, 5)
        days = spark.sql("select explode(sequence(date'2025-03-05', date'2026-05-01')) as d")
        assert [r["a"] for r in days.select(refits.anchor_of(F.col("d"), every).alias("a")).distinct().orderBy("a").collect()] == got


def test_fits_run_side_by_side_in_order():
    assert refits.side_by_side(lambda a, b: a * b, [(k, 2) for k in range(9)]) == [2 * k for k in range(9)]


def test_boosting_finds_level_and_spread(spark):
    x, noise = F.rand(3), F.randn(4)
    rows = spark.range(6000).select(*[F.lit(0.0).alias(c) for c in FEATURE_COLUMNS if c not in ("temp", "hour")], x.alias("temp"), F.rand(5).alias("hour"), noise.alias("e")).persist()
    rows = rows.withColumn("y", F.when(F.col("temp") > 0.5, 50.0).otherwise(0.0) + F.col("e") * F.when(F.col("hour") > 0.5, 8.0).otherwise(1.0))
    train, rest = rows.randomSplit([0.7, 0.3], 1)
    model = boosting.fit(train.repartition(1), boosting.BoostingSize(stages=12, rate=0.4, depth=3, min_leaf=40))
    out = model.predict(boosting.vectors(rest)).withColumn("wide", F.col("hour") > 0.5)
    for r in out.groupBy("wide", F.col("temp") > 0.5).agg(
        F.avg((F.col("y") <= F.col("f10")).cast("double")).alias("a"), F.avg((F.col("y") <= F.col("f50")).cast("double")).alias("b"),
        F.avg((F.col("y") <= F.col("f90")).cast("double")).alias("c"), F.avg(F.col("f90") - F.col("f10")).alias("width"),
    ).collect():
        assert abs(r["a"] - 0.1) < 0.06 and abs(r["b"] - 0.5) < 0.1 and abs(r["c"] - 0.9) < 0.06
        assert 15 < r["width"] < 27 if r["wide"] else r["width"] < 6  # the spread of the noise: 20.5 and 2.6; without leaves of its own 12


def test_refusals_cutoff_and_leaks(panel):
    """A target without covariates, or with covariates that came too late, is refused; later prices change nothing."""
    slots, covariates = panel
    day = t.local_date(F.col("valid_utc"), HOURLY.tz)
    targets = [date(2026, 7, 1) + timedelta(days=k) for k in range(8)]
    absent, late, part = date(2026, 7, 3), date(2026, 7, 5), date(2026, 7, 6)
    odd = covariates.withColumn("solar", F.when((day != F.lit(absent)) & ((day != F.lit(part)) | (F.hour("valid_utc") > 9)), F.col("solar")))
    odd = odd.withColumn("available_at_utc", F.when(day == F.lit(late), F.col("valid_utc")).otherwise(F.col("available_at_utc")))
    got = points_of(slots, odd, targets)
    assert set(got) == {(h, d) for h in (1, 2) for d in targets if d not in (absent, late)}
    actual = {r["day"]: r["values"] for r in packed(slots).collect()}
    errors = [abs(y - v) for (h, d), q in got.items() for y, v in zip(actual[d], q[1], strict=True)]
    assert sum(errors) / len(errors) < 8 and all(a <= b <= c for q in got.values() for a, b, c in zip(*q, strict=True))
    changed = slots.withColumn("value", F.when(F.col("slot_utc") >= F.lit("2026-07-04 22:00:00").cast("timestamp"), 999.0).otherwise(F.col("value")))
    again = points_of(changed, odd, targets)
    same = [k for k in got if k[1] - timedelta(days=k[0]) <= date(2026, 7, 4)]
    assert len(same) >= 6 and all(again[k] == got[k] for k in same) and any(again[k] != got[k] for k in set(got) - set(same))


def test_replay_equals_a_live_run(panel):
    slots, covariates = panel
    replay = points_of(slots, covariates, [date(2026, 6, 20) + timedelta(days=k) for k in range(12)])
    # the live run of one day: nothing after the issue day exists yet, only the forecast of the target's weather
    issue = date(2026, 6, 30)
    known = slots.filter(t.local_date(F.col("slot_utc"), HOURLY.tz) <= F.lit(issue))
    live = points_of(known, covariates.filter(t.local_date(F.col("valid_utc"), HOURLY.tz) <= F.lit(issue + timedelta(days=1))), [issue + timedelta(days=1)])
    assert live[1, issue + timedelta(days=1)] == replay[1, issue + timedelta(days=1)]


def test_five_models_in_one_replay(spark, panel):
    """All models are due on all days; early days are missed; bands of the learned models hold about 80 %."""
    slots, covariates = panel
    days = packed(slots).persist()
    specs = tuple(replace(s, error_days=20, min_error_days=10) for s in (backtest.lasso.LASSO_SPEC, boosting.BOOST_SPEC))
    naive = tuple(replace(s, error_days=20, min_error_days=10) for s in backtest.NAIVE_SPECS)
    learned = backtest.learned_bands(days, covariates, HOURLY, 56, SMALL, specs, (56,))
    scores = backtest.full_backtest(days, learned, HOURLY, naive, specs).persist()
    per = {r["model"]: r for r in scores.groupBy("model").agg(
        F.count_distinct("target_date", "horizon_days").alias("n"), F.avg("in_band").alias("cover") if dict(scores.dtypes)["in_band"] != "boolean" else F.avg(F.col("in_band").cast("double")).alias("cover"),
        F.avg("abs_error").alias("mae"), F.max(F.when(F.col("status") == "missed", F.col("target_date"))).alias("missed"),
    ).collect()}
    assert len(per) == 5 and len({r["n"] for r in per.values()}) == 1
    for name in ("lasso_ar", "quantile_boosting"):
        assert 0.68 < per[name]["cover"] < 0.92 and per[name]["missed"] is not None
    assert per["quantile_boosting"]["mae"] < 0.8 * min(per[s.name]["mae"] for s in naive)  # only it sees the wind
    models = {r["model_key"] for r in summary.metric_cube(scoring.pack_scores(scores), HOURLY).select("model_key").distinct().collect()}
    assert {"lasso_ar.v1", "quantile_boosting.v1"} < models
    assert summary.diebold_mariano(summary.daily_scores(scores), HOURLY).count() > 0


def test_fits_take_tasks_by_rows_not_by_the_session(spark, panel, monkeypatch):
    """Stored frames of a fit have as many partitions as their hours need; with the session's number each fit would send that many times its counters."""
    slots, covariates = panel
    days, found = packed(slots), []

    def recorded(df):
        out = materialize(df)
        if {"hour", "features", "scale"} & set(df.columns):
            found.append((tuple(df.columns), out.rdd.getNumPartitions()))
        return out

    for module in (lasso, boosting):
        monkeypatch.setattr(module, "materialize", recorded)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        asked = spark.createDataFrame([("s", LAST)], "series_id string, target_date date")
        hourly = lasso.lasso_hourly(shaping.hourly_matrix(days, HOURLY), asked, HOURLY, [LAST - timedelta(days=4)], None, (28,), (0.01,))
        assert hourly.count() == 2
        assert boosting.boosted_points(days, covariates, asked, HOURLY, 28, replace(SMALL, stages=1)).count() == 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert refits.hourly_tasks(days) == 1 and len(found) >= 10
    assert {n for _, n in found} == {1}, found
