"""What a delivery changes in a month archive, and the merge of covariates (storage: ``versions``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.config import LedgerConfig
from slotledger.functions import timecols as t
from slotledger.operators.observations import latest_wins
from slotledger.sources.feeds import WEATHER_FEATURES


def local_month(ts: Column, cfg: LedgerConfig) -> Column:
    return F.date_format(t.local_ts(ts, cfg.tz), "yyyy-MM")


def changed_months(old: DataFrame, fresh: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Months (column ``month``) in which a fresh row is new or differs, with how many rows do."""
    before = old.select(*keys, F.struct(*values).alias("was"))
    after = fresh.select("month", *keys, F.struct(*values).alias("now"))
    joined = after.join(before, list(keys), "left")
    differs = joined.filter(~F.col("now").eqNullSafe(F.col("was")))
    return differs.groupBy("month").agg(F.count("*").alias("changed_rows"))


def normalize_covariates(df: DataFrame) -> DataFrame:
    """Feature values as archived: three decimals, halves to even."""
    rounded = [F.bround(F.col(f).cast("double"), 3).alias(f) for f in WEATHER_FEATURES]
    rest = [c for c in df.columns if c not in WEATHER_FEATURES]
    return df.select(*rest, *rounded)


def covariate_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of two covariate tables; the newer row wins per valid hour and lead time."""
    both = old.withColumn("rank", F.lit(0)).unionByName(new.withColumn("rank", F.lit(1)))
    merged = latest_wins(both, ["series_id", "valid_utc", "lead_days"], ["rank"])
    return normalize_covariates(merged.drop("rank"))
