"""Scores rolled up into windows, segments, models and horizons, with significance tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotledger.config import REFERENCE_MODEL, LedgerConfig
from slotledger.functions import timecols as t
from slotledger.functions.losses import skill
from slotledger.functions.quantiles import exact_quantile
from slotledger.functions.stats import t_two_sided
from slotledger.models.requests import model_key
from slotledger.operators.scoring import slots_of


def scored() -> Column:
    return F.col("status") == "scored"


def latest_targets(df: DataFrame) -> DataFrame:
    return df.groupBy("series_id").agg(F.max("target_date").alias("latest"))


def with_latest(df: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """Adds the latest target day of the series (one row per series joins back)."""
    return df.join(latest_targets(df) if latest is None else latest, "series_id")


def window_tags(cfg: LedgerConfig) -> Column:
    """Names of the rolling windows a target day falls into, counted back from the latest one."""
    tags = [
        F.lit(name) if days is None else F.when(F.col("target_date") > F.date_sub("latest", days), name)
        for name, days in cfg.windows
    ]
    return F.array_compact(F.array(*tags))


def in_windows(df: DataFrame, cfg: LedgerConfig, latest: DataFrame | None = None) -> DataFrame:
    """One row per window a row belongs to; meant for tables already reduced to days."""
    return with_latest(df, latest).withColumn("window", F.explode(window_tags(cfg))).drop("latest")


def scored_slots(scores: DataFrame) -> DataFrame:
    """Distinct slots of a score table with their actual value."""
    return scores.groupBy("series_id", "target_date", "slot_utc").agg(F.first("actual").alias("actual"))


def observed_slots(days: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """The same from packed actuals, when every observed day is due."""
    cells = F.arrays_zip(t.day_slots(F.col("day"), cfg).alias("slot_utc"), F.col("values").alias("actual"))
    return days.select("series_id", F.col("day").alias("target_date"), F.inline(cells).alias("slot_utc", "actual"))


def spike_thresholds(slots: DataFrame, cfg: LedgerConfig, q: float = 0.9) -> DataFrame:
    """90th percentile of the distinct-slot actuals of each window.

    ``slots`` is ``scored_slots`` or ``observed_slots``. Equal values of a day collapse to counts
    before windows multiply them.
    """
    counts = slots.filter(F.col("actual").isNotNull()).groupBy("series_id", "target_date", "actual").agg(
        F.count("*").alias("n")
    )
    return exact_quantile(in_windows(counts, cfg), ["series_id", "window"], "actual", q, "spike_threshold", "n")


def slots_of_days(scored_days: DataFrame) -> DataFrame:
    """``scored_slots`` of packed days."""
    day = scored_days.groupBy("series_id", "target_date").agg(F.first(F.struct("slots", "actual")).alias("d"))
    cells = F.arrays_zip(F.col("d.slots").alias("slots"), F.col("d.actual").alias("actual"))
    return day.select("series_id", "target_date", F.inline(cells).alias("slot_utc", "actual"))


def with_reference(scored_days: DataFrame, reference: str = REFERENCE_MODEL, per_series: DataFrame | None = None) -> DataFrame:
    """Score rows with the reference model's absolute error on the same slot and horizon, NULL where it was not scored.

    ``scored_days`` is packed (``scoring.score_days``, ``scoring.pack_scores``). The models of one day meet in one row of vectors, the one
    exchange of this step; the reference's errors go to the others by array arithmetic and slots are spread last. ``per_series`` has
    one row per series whose columns are added before slots are spread.
    """
    keys = ["series_id", "horizon_days", "target_date"]
    fields = [c for c in scored_days.columns if c not in keys]
    met = scored_days.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("models"))
    is_ref = lambda m: (F.concat(m["model"], F.lit(".v"), m["model_version"]) == reference) & (m["status"] == "scored")
    met = met.withColumn("ref", F.get(F.filter("models", is_ref), F.lit(0)))
    if per_series is not None:
        met = met.join(per_series, "series_id")
    met = met.withColumn("ref_errors", F.zip_with("ref.actual", "ref.q50", lambda y, x: F.abs(y - x)))
    others = [c for c in met.columns if c not in {"models", "ref"}]
    flat = met.select(*others, F.col("ref.slots").alias("ref_slots"), F.inline("models").alias(*fields))
    by_slot = lambda s: F.try_element_at(F.map_from_arrays("ref_slots", "ref_errors"), s)
    same = F.when(F.col("slots") == F.col("ref_slots"), F.col("ref_errors")).when(F.col("ref_slots").isNotNull(), F.transform("slots", by_slot))
    days = flat.withColumn("ref_abs_error", F.coalesce(same, F.transform("slots", lambda _: F.lit(None).cast("double"))))
    return slots_of(days.drop("ref_slots", "ref_errors"), "ref_abs_error")


SUMS = ("n", "abs", "sq", "pin", "inside", "n_pair", "abs_pair", "ref_pair")


def _sums(name: str, cond: Column) -> list[Column]:
    ok = cond & scored()
    pair = ok & F.col("ref_abs_error").isNotNull()
    of = lambda c, hit: F.coalesce(F.sum(F.when(hit, c)), F.lit(0.0))
    return [
        F.count(F.when(ok, F.lit(1))).alias(f"{name}_n"),
        of(F.col("abs_error"), ok).alias(f"{name}_abs"),
        of(F.col("sq_error"), ok).alias(f"{name}_sq"),
        of(F.col("pinball"), ok).alias(f"{name}_pin"),
        of(F.col("in_band").cast("double"), ok).alias(f"{name}_inside"),
        F.count(F.when(pair, F.lit(1))).alias(f"{name}_n_pair"),
        of(F.col("abs_error"), pair).alias(f"{name}_abs_pair"),
        of(F.col("ref_abs_error"), pair).alias(f"{name}_ref_pair"),
    ]


def metric_cube(
    scored_days: DataFrame, cfg: LedgerConfig, slots: DataFrame | None = None, reference: str = REFERENCE_MODEL,
    rounded: bool = True,
) -> DataFrame:
    """Metrics per window, model, horizon and segment.

    ``scored_days`` is packed (``scoring.score_days``, ``scoring.pack_scores``). ``slots`` supplies the distinct slots for the spike
    thresholds where they are at hand without reading the scores again.

    Slots first shrink to sums per day (conditional sums, no row is copied per window or segment);
    windows and segments then only multiply the day rows.
    """
    names = [name for name, _ in cfg.windows]
    slots = slots_of_days(scored_days) if slots is None else slots
    limits = spike_thresholds(slots, cfg).groupBy("series_id").agg(
        *[F.max(F.when(F.col("window") == n, F.col("spike_threshold"))).alias(f"spike_{n}") for n in names]
    )
    rows = with_reference(scored_days, reference, limits)
    sums = _sums("all", F.lit(True)) + _sums("negative", F.col("actual") < 0)
    for n in names:
        sums += _sums(f"spike_{n}", F.col("actual") >= F.col(f"spike_{n}"))
    daily = rows.groupBy("series_id", model_key().alias("model_key"), "horizon_days", "target_date").agg(*sums)

    def bundle(prefix: str, segment: str) -> Column:
        return F.struct(F.lit(segment).alias("segment"), *[F.col(f"{prefix}_{m}").alias(m) for m in SUMS])

    weekend = F.weekday("target_date") >= 5
    spike = F.lit(None)
    for n in names:
        spike = F.when(F.col("window") == n, bundle(f"spike_{n}", "price_spike")).otherwise(spike)
    segments = F.array(
        bundle("all", "all"),
        F.when(weekend, bundle("all", "weekend")).otherwise(bundle("all", "weekday")),
        bundle("negative", "negative_price"),
        spike,
    )
    tagged = in_windows(daily, cfg, latest_targets(slots))
    keys = ["series_id", "window", "model_key", "horizon_days"]
    flat = tagged.select(*keys, "target_date", F.explode(segments).alias("s")).select(*keys, "target_date", "s.*")
    cube = flat.groupBy(*keys, "segment").agg(
        F.count("*").alias("days"),
        F.count(F.when(F.col("n") > 0, F.lit(1))).alias("days_scored"),
        *[F.sum(m).alias(m) for m in SUMS],
    )
    n = F.nullif(F.col("n"), F.lit(0))
    n_pair = F.nullif(F.col("n_pair"), F.lit(0))
    over = Window.partitionBy(*keys)
    whole = lambda c: F.max(F.when(F.col("segment") == "all", F.col(c))).over(over)
    cut = F.bround if rounded else (lambda c, _: c)
    return cube.select(
        *keys,
        "segment",
        whole("days").alias("days_due"),
        whole("days_scored").alias("days_forecast"),
        F.col("n").alias("n_slots"),
        cut(F.col("abs") / n, 3).alias("mae"),
        cut(F.sqrt(F.col("sq") / n), 3).alias("rmse"),
        cut(F.col("pin") / n, 3).alias("pinball"),
        cut(F.col("inside") / n, 3).alias("coverage_80"),
        cut(skill(F.col("abs_pair") / n_pair, F.col("ref_pair") / n_pair), 4).alias("skill_mae"),
    )


def headline_metrics(scores: DataFrame) -> DataFrame:
    """MAE, RMSE, pinball and coverage over all scored rows of a model and horizon."""
    ok = scores.filter(scored())
    return ok.groupBy("series_id", model_key().alias("model_key"), "horizon_days").agg(
        F.count("*").alias("n_slots"),
        F.avg("abs_error").alias("mae"),
        F.sqrt(F.avg("sq_error")).alias("rmse"),
        F.avg("pinball").alias("pinball"),
        F.avg(F.col("in_band").cast("double")).alias("coverage_80"),
    )


def skill_vs_reference(scored_days: DataFrame, reference: str = REFERENCE_MODEL) -> DataFrame:
    paired = with_reference(scored_days, reference).filter(scored() & F.col("ref_abs_error").isNotNull())
    means = paired.groupBy("series_id", model_key().alias("model_key"), "horizon_days").agg(
        F.count("*").alias("n_paired"),
        F.avg("abs_error").alias("mae"),
        F.avg("ref_abs_error").alias("mae_ref"),
    )
    return means.withColumn("skill_mae", skill(F.col("mae"), F.col("mae_ref")))


def segments_of(scores: DataFrame, thresholds: DataFrame, window: str = "all") -> DataFrame:
    """Rows tagged with every segment they belong to; segments overlap."""
    limit = thresholds.filter(F.col("window") == window).select("series_id", "spike_threshold")
    weekend = F.weekday("target_date") >= 5
    tags = F.array_compact(
        F.array(
            F.lit("all"),
            F.when(weekend, "weekend").otherwise("weekday"),
            F.when(F.col("actual") < 0, "negative_price"),
            F.when(F.col("actual") >= F.col("spike_threshold"), "price_spike"),
        )
    )
    return scores.join(limit, "series_id").withColumn("segment", F.explode(tags))


def daily_scores(scores: DataFrame) -> DataFrame:
    """Per model, horizon, target day and status."""
    return scores.groupBy(
        "series_id", model_key().alias("model_key"), "horizon_days", "target_date", "issue_date", "status"
    ).agg(
        F.avg("abs_error").alias("mae"),
        F.sqrt(F.avg("sq_error")).alias("rmse"),
        F.avg("pinball").alias("pinball"),
        F.avg(F.col("in_band").cast("double")).alias("coverage_80"),
        F.count("*").alias("n_slots"),
    )


def missed_list(scores: DataFrame) -> DataFrame:
    gone = scores.filter(~scored())
    return gone.select(
        "series_id", model_key().alias("model_key"), "horizon_days", "target_date", "issue_date", "status"
    ).distinct()


def diebold_mariano(daily: DataFrame, cfg: LedgerConfig, latest: DataFrame | None = None, rounded: bool = True) -> DataFrame:
    """Paired test of every model pair on daily MAE, per window and horizon.

    ``daily`` is ``daily_scores``. The models of one day meet in one small list that is expanded
    to pairs; autocovariance lags count paired days, not calendar days.
    """
    ok = daily.filter(scored())
    per_day = ok.groupBy("series_id", "horizon_days", "target_date").agg(
        F.sort_array(F.collect_list(F.struct("model_key", "mae"))).alias("m")
    )
    pairs = F.flatten(
        F.transform(
            "m",
            lambda x: F.transform(
                F.filter("m", lambda y: y["model_key"] > x["model_key"]),
                lambda y: F.struct(
                    x["model_key"].alias("model_a"),
                    y["model_key"].alias("model_b"),
                    (x["mae"] - y["mae"]).alias("d"),
                ),
            ),
        )
    )
    rows = per_day.select("series_id", "horizon_days", "target_date", F.inline(pairs))
    # windows count back from the latest day of the ledger, not of the pair
    latest = latest_targets(daily) if latest is None else latest
    rows = rows.join(latest, "series_id").withColumn("window", F.explode(window_tags(cfg)))
    keys = ["series_id", "window", "horizon_days", "model_a", "model_b"]
    group = Window.partitionBy(*keys)
    order = group.orderBy("target_date")
    centred = rows.withColumn("mean_d", F.avg("d").over(group)).withColumn("dc", F.col("d") - F.col("mean_d"))
    lags = range(1, max(cfg.horizons))
    for k in lags:
        centred = centred.withColumn(f"lag{k}", F.lag("dc", k).over(order))
    stats = centred.groupBy(*keys).agg(
        F.count("*").alias("n_days"),
        F.max("mean_d").alias("mean_d"),
        F.sum(F.col("dc") * F.col("dc")).alias("g0"),
        *[F.sum(F.col("dc") * F.col(f"lag{k}")).alias(f"g{k}") for k in lags],
    )
    n = F.col("n_days").cast("double")
    total = F.col("g0") / n
    for k in lags:
        total = total + F.when(F.col("horizon_days") > k, 2.0 * F.coalesce(F.col(f"g{k}"), F.lit(0.0)) / n).otherwise(0.0)
    h = F.col("horizon_days").cast("double")
    var = total / n
    enough = (F.col("n_days") >= cfg.min_dm_days) & (F.col("n_days") >= 3)
    usable = enough & (F.col("var") > 0)
    hln = F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    tested = stats.withColumn("var", var).withColumn(
        "stat", F.when(usable, F.col("mean_d") / F.sqrt("var") * hln)
    )
    cut = F.bround if rounded else (lambda c, _: F.col(c) if isinstance(c, str) else c)
    p = t_two_sided(F.col("stat"), F.col("n_days") - 1)
    return tested.select(
        *keys,
        "n_days",
        cut("stat", 3).alias("statistic"),
        cut(F.when(F.col("stat").isNotNull(), p), 4).alias("p_value"),
        cut(F.when(enough, F.col("mean_d")), 3).alias("mean_daily_mae_diff"),
    )


def worst_days(daily: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The ``n`` days with the largest MAE per key; ties by target day."""
    w = Window.partitionBy(*keys).orderBy(F.col("mae").desc(), F.col("target_date"))
    return daily.filter(scored()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def worst_day_slots(scores: DataFrame, daily: DataFrame, n: int = 12) -> DataFrame:
    keys = ["series_id", "model_key", "horizon_days"]
    worst = worst_days(daily, n, keys).select(*keys, "target_date", "rank")
    rows = scores.withColumn("model_key", model_key())
    return rows.join(worst, [*keys, "target_date"]).select(
        *keys, "target_date", "rank", "slot_utc", "actual", "q10", "q50", "q90"
    )


def featured_model(daily: DataFrame, cfg: LedgerConfig, reference: str = REFERENCE_MODEL) -> DataFrame:
    """Best recent model at horizon 1 among those with enough days, else the reference."""
    ok = daily.filter(scored() & (F.col("horizon_days") == 1))
    recent = with_latest(ok).filter(F.col("target_date") > F.date_sub("latest", cfg.feature_window_days))
    means = recent.groupBy("series_id", "model_key").agg(
        F.countDistinct("target_date").alias("n_days"), F.avg("mae").alias("mean_mae")
    )
    eligible = means.filter(F.col("n_days") >= cfg.feature_min_days)
    best = eligible.groupBy("series_id").agg(
        F.min(F.struct("mean_mae", "model_key")).alias("best")
    )
    series = daily.select("series_id").distinct()
    return series.join(best, "series_id", "left").select(
        "series_id",
        F.coalesce("best.model_key", F.lit(reference)).alias("featured_model"),
        F.when(F.col("best").isNotNull(), "best_recent").otherwise("reference_until_enough_days").alias("rule"),
    )


def window_summary(
    realized: DataFrame, cfg: LedgerConfig, latest: DataFrame | None = None, rounded: bool = True
) -> DataFrame:
    """Hit rates, stated probabilities, Brier scores, regret and saving of recommended windows."""
    rows = in_windows(realized.withColumn("model_key", model_key()), cfg, latest)
    cut = F.bround if rounded else (lambda c, _: c)
    hit, near = F.col("hit").cast("double"), F.col("near").cast("double")
    sq = lambda p, y: (F.col(p) - y) * (F.col(p) - y)
    of = lambda c: F.avg(F.when(scored(), c))
    return rows.groupBy("series_id", "window", "model_key", "horizon_days").agg(
        F.count("*").alias("days_due"),
        F.count(F.when(scored(), F.lit(1))).alias("days_scored"),
        cut(of(hit), 3).alias("hit_rate"),
        cut(of(F.col("p_cheapest")), 3).alias("mean_p_cheapest"),
        cut(of(sq("p_cheapest", hit)), 4).alias("brier_cheapest"),
        cut(of(near), 3).alias("near_rate"),
        cut(of(F.col("p_near")), 3).alias("mean_p_near"),
        cut(of(sq("p_near", near)), 4).alias("brier_near"),
        cut(of(F.col("regret")), 2).alias("mean_regret"),
        cut(of(F.col("actual_day_mean") - F.col("actual_mean_recommended")), 2).alias("saving_vs_day_mean"),
    )
