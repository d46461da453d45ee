"""The forecasts that are asked for: series x target day x model x horizon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.config import LedgerConfig, ModelSpec


def _model_structs(specs: Sequence[ModelSpec], cfg: LedgerConfig) -> Column:
    rows = [
        F.struct(
            F.lit(s.name).alias("model"),
            F.lit(s.version).alias("model_version"),
            F.lit(s.rule).cast("string").alias("rule"),
            F.lit(s.error_days).alias("error_days"),
            F.lit(s.min_error_days).alias("min_error_days"),
            F.lit(s.live_since).cast("date").alias("live_since"),
            F.lit(s.retired_after).cast("date").alias("retired_after"),
            F.lit(h).alias("horizon_days"),
        )
        for s in specs
        for h in cfg.horizons
    ]
    return F.array(*rows)


def forecast_requests(targets: DataFrame, specs: Sequence[ModelSpec], cfg: LedgerConfig) -> DataFrame:
    """Expand ``(series_id, target_date)`` to every model and horizon; a narrow step."""
    fields = [
        "model", "model_version", "rule", "error_days", "min_error_days", "live_since",
        "retired_after", "horizon_days",
    ]
    grid = targets.select("series_id", "target_date", F.inline(_model_structs(specs, cfg)).alias(*fields))
    return grid.withColumn("issue_date", F.date_sub("target_date", F.col("horizon_days")))


def model_key() -> Column:
    return F.concat(F.col("model"), F.lit(".v"), F.col("model_version"))
