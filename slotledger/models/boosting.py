"""Quantile boosting: regression trees on the gradient of the pinball losses, stage by stage, pooled over hours and series.

A stage fits one Spark ML tree to the summed gradients of the three losses; each leaf then moves each quantile by a share of that
quantile of its residuals, read from mergeable sketches. The tree says where the forecast is wrong, the leaves by how much, so a
stage costs one tree for all quantiles. Bands are calibrated conformally afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.config import LedgerConfig, ModelSpec
from slotledger.functions import timecols as t
from slotledger.functions.arrays import field_of
from slotledger.functions.losses import sort_quantiles
from slotledger.models.refits import anchors_between, hourly_tasks, issue_span, side_by_side
from slotledger.operators import features as feat
from slotledger.operators import shaping
from slotledger.session import materialize
from slotledger.sources.feeds import WEATHER_FEATURES

BOOST_SPEC = ModelSpec("quantile_boosting", error_days=60, min_error_days=20)
MIN_TRAINING_DAYS = 120
QUANTILES = (0.1, 0.5, 0.9)
STATES = ("f10", "f50", "f90")
#: Stands for a missing feature value: below every real one, so a split can part it.
MISSING = -1.0e6
#: Days that one fit serves.
REFIT_DAYS = 364
ACCURACY = 10_000
#: Training rows of a task; a stage is many short jobs, which more and smaller tasks only slow down.
TASK_ROWS = 200_000
KEYS = ("series_id", "horizon_days", "issue_date", "target_date")


@dataclass(frozen=True)
class BoostingSize:
    stages: int = 12
    rate: float = 0.35
    depth: int = 5
    min_leaf: int = 40


@dataclass(frozen=True)
class Boosted:
    """Start values and, for each stage, a tree with the moves of its leaves (at most 2^depth)."""

    start: tuple[float, ...]
    stages: tuple[tuple[DecisionTreeRegressionModel, tuple[tuple[float, ...], ...]], ...]

    def predict(self, rows: DataFrame) -> DataFrame:
        out = with_states(rows, self.start)
        for tree, moves in self.stages:
            out = moved(tree.transform(out), moves).drop("leaf", "direction")
        return out


def vectors(rows: DataFrame) -> DataFrame:
    filled = rows.fillna({c: MISSING for c in feat.FEATURE_COLUMNS})
    return VectorAssembler(inputCols=list(feat.FEATURE_COLUMNS), outputCol="features").transform(filled)


def with_states(rows: DataFrame, start: tuple[float, ...]) -> DataFrame:
    return rows.withColumns({s: F.lit(v) for s, v in zip(STATES, start, strict=True)})


def moved(leaves: DataFrame, moves: tuple[tuple[float, ...], ...]) -> DataFrame:
    """States after a stage: each row takes the moves of its leaf."""
    at = F.col("leaf").cast("int")
    return leaves.withColumns({s: F.col(s) + F.get(F.array(*[F.lit(m[k]) for m in moves]), at) for k, s in enumerate(STATES)})


def gradient() -> Column:
    """Sum over the quantiles of the pinball loss's downhill direction: q above the forecast, q - 1 below it."""
    return sum(F.when(F.col("y") > F.col(s), q).otherwise(q - 1) for s, q in zip(STATES, QUANTILES, strict=True))


def residual_quantiles() -> list[Column]:
    return [F.percentile_approx(F.col("y") - F.col(s), q, ACCURACY).alias(s) for s, q in zip(STATES, QUANTILES, strict=True)]


def fit(train: DataFrame, size: BoostingSize = BoostingSize(), seed: int = 0) -> Boosted:
    """``train``: rows with the feature columns and ``y``."""
    zero = materialize(with_states(vectors(train).select("features", "y"), (0.0, 0.0, 0.0)))
    start = tuple(float(v) for v in zero.agg(*residual_quantiles()).first())
    state = with_states(zero.drop(*STATES), start)
    learner = DecisionTreeRegressor(
        featuresCol="features", labelCol="gradient", predictionCol="direction", leafCol="leaf", maxDepth=size.depth, minInstancesPerNode=size.min_leaf, seed=seed,
    )
    stages = []
    for _ in range(size.stages):
        tree = learner.fit(state.withColumn("gradient", gradient()))
        leaves = materialize(tree.transform(state).drop("direction"))  # cuts the plan, which would grow by every stage
        found = {int(r["leaf"]): r for r in leaves.groupBy("leaf").agg(*residual_quantiles()).collect()}
        n_leaves = (tree.numNodes + 1) // 2
        moves = tuple(tuple(size.rate * float(found[i][s]) if i in found else 0.0 for s in STATES) for i in range(n_leaves))
        stages.append((tree, moves))
        state = moved(leaves, moves).select("features", "y", *STATES)
    return Boosted(start, tuple(stages))


def training_rows(table: DataFrame, anchor: date) -> DataFrame:
    """Rows of targets up to the anchor whose lagged values are known."""
    return table.filter(F.col("target_date") <= F.lit(anchor)).dropna(subset=["y", "p_last_hour", "p_week_hour", "p_week_mean"])


def answerable(table: DataFrame) -> DataFrame:
    """Rows that can be forecast: the level is known and no covariate is wholly absent on the target day.

    Gaps within a day are filled before, so a missing covariate is missing at all hours; such a target is refused.
    """
    return table.dropna(subset=["p_last_hour", "p_week_mean", *WEATHER_FEATURES])


def on_time(covariates: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """Covariates published by the issue time of the forecasts that use them (lead days less one before the day)."""
    if "available_at_utc" not in covariates.columns:
        return covariates
    issue = F.date_sub(t.local_date(F.col("valid_utc"), cfg.tz), F.col("lead_days") - 1)
    return covariates.filter(F.col("available_at_utc") <= t.covariates_known_until(issue, cfg))


def raw_hourly(table: DataFrame, anchors: list[date], every: int, size: BoostingSize) -> list[DataFrame]:
    """Raw hourly quantiles of the answerable rows of one horizon, by the fit of each row's anchor; one frame an anchor."""

    def of_anchor(anchor: date) -> DataFrame | None:
        train = training_rows(table, anchor)
        n_days, n_rows = train.agg(F.count_distinct("target_date"), F.count(F.lit(1))).first()
        if n_days < MIN_TRAINING_DAYS:
            return None
        model = fit(train.repartition(-(-n_rows // TASK_ROWS)), size)
        served = answerable(table).filter((F.col("issue_date") >= F.lit(anchor)) & (F.col("issue_date") < F.date_add(F.lit(anchor), every)))
        out = model.predict(vectors(served))
        low, middle, high = sort_quantiles(*[F.col(s) + F.col("p_week_mean") for s in STATES])
        return materialize(out.select(*KEYS, "hour", low.alias("raw10"), middle.alias("raw50"), high.alias("raw90")))

    return [part for part in side_by_side(of_anchor, [(a,) for a in anchors]) if part is not None]


def boosted_points(
    days: DataFrame, covariates: DataFrame, asked: DataFrame, cfg: LedgerConfig, every: int = REFIT_DAYS, size: BoostingSize = BoostingSize(),
    spec: ModelSpec = BOOST_SPEC,
) -> DataFrame:
    """Native quantile vectors (``raw10``, ``point``, ``raw90``) of the asked ``(series_id, target_date)``, each by the fit of its anchor."""
    matrix = materialize(shaping.hourly_matrix(days, cfg))
    cov = materialize(feat.covariate_matrix(on_time(covariates, cfg), cfg))
    tasks = hourly_tasks(matrix)
    asked = materialize(asked.select("series_id", "target_date").distinct().repartition(tasks, "series_id", "target_date"))

    def of_horizon(h: int) -> list[DataFrame]:
        table = materialize(feat.pooled_features(matrix, cov, h).repartition(tasks, "series_id", "target_date"))
        span = issue_span(asked.withColumn("issue_date", F.date_sub("target_date", h)))
        if span is None:
            return []
        return [p.join(asked, ["series_id", "target_date"], "left_semi") for p in raw_hourly(table, anchors_between(*span, every), every, size)]

    parts = [p for ps in side_by_side(of_horizon, [(h,) for h in cfg.horizons]) for p in ps]
    if parts:
        hourly = reduce(DataFrame.unionByName, parts)
    else:
        hourly = matrix.sparkSession.createDataFrame([], "series_id string, horizon_days int, issue_date date, target_date date, hour double, raw10 double, raw50 double, raw90 double")
    packed = hourly.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("hour", "raw10", "raw50", "raw90"))).alias("h"))
    arrays = packed.filter(F.size("h") == 24).select(*KEYS, *[field_of("h", c).alias(c) for c in ("raw10", "raw50", "raw90")])
    arrays = materialize(arrays)
    shapes = shaping.shape_vectors(shaping.intra_hour_shape(days, cfg, arrays.select("series_id", "issue_date").distinct()), cfg)
    laid = shaping.to_slots(arrays, shapes, cfg, ("raw10", "raw50", "raw90"))
    return laid.select(
        "series_id", "target_date", F.lit(spec.name).alias("model"), F.lit(spec.version).alias("model_version"),
        F.lit(spec.error_days).alias("error_days"), F.lit(spec.min_error_days).alias("min_error_days"),
        "horizon_days", "issue_date", "n_slots", "clocks",
        F.col("raw10_slots").alias("raw10"), F.col("raw50_slots").alias("point"), F.col("raw90_slots").alias("raw90"),
    )


