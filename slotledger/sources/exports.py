"""Flat exports for BI tools, the column dictionary and the snapshot of the latest issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from slotledger.config import LedgerConfig
from slotledger.functions import timecols as t
from slotledger.models.requests import model_key

#: What each exported column says, for every table that has it: unit and comment.
COMMENTS: dict[str, tuple[str, str]] = {
    "series_id": ("", "Which series the row belongs to"),
    "model": ("", "Rule or learner"),
    "model_version": ("", "Version of the rule or learner"),
    "model_key": ("", "Rule or learner with its version, as used in file names"),
    "horizon_days": ("days", "Distance from issue day to target day"),
    "issue_date": ("", "Day the numbers were made"),
    "target_date": ("", "Day the numbers are about"),
    "slot_utc": ("UTC", "When the slot begins"),
    "delivery_start_utc": ("UTC", "When the slot begins"),
    "delivery_date_local": ("", "Calendar day of the slot on the local clock"),
    "delivery_time_local": ("HH:MM", "Local clock at the slot's beginning; not unique on the day clocks go back"),
    "q10": ("EUR/MWh", "One outcome in ten should be lower"),
    "q50": ("EUR/MWh", "Half of the outcomes should be lower"),
    "q90": ("EUR/MWh", "Nine outcomes in ten should be lower"),
    "price_eur_mwh": ("EUR/MWh", "What was measured"),
    "actual": ("EUR/MWh", "What was measured"),
    "status": ("", "Whether the due numbers came, came with holes, or never came"),
    "error": ("EUR/MWh", "Measured less middle quantile"),
    "abs_error": ("EUR/MWh", "Size of the error"),
    "sq_error": ("(EUR/MWh)^2", "Square of the error"),
    "pinball": ("EUR/MWh", "Quantile loss, averaged over the three quantiles"),
    "in_band": ("", "Measured between the outer quantiles"),
    "mae": ("EUR/MWh", "Mean size of the error over the day"),
    "rmse": ("EUR/MWh", "Root of the day's mean squared error"),
    "coverage_80": ("", "Share of the day's slots between the outer quantiles"),
    "n_slots": ("slots", "Slots of the day"),
    "window_start_utc": ("UTC", "When the recommended window begins"),
    "expected_mean": ("EUR/MWh", "Mean of the window as forecast"),
    "p_cheapest": ("", "Stated chance that no window is cheaper"),
    "p_near": ("", "Stated chance that the window is close to the cheapest"),
    "actual_best_start_utc": ("UTC", "When the cheapest window began"),
    "actual_mean_recommended": ("EUR/MWh", "Measured mean of the recommended window"),
    "actual_mean_best": ("EUR/MWh", "Measured mean of the cheapest window"),
    "actual_day_mean": ("EUR/MWh", "Measured mean of the day"),
    "hit": ("", "The recommended window was the cheapest"),
    "near": ("", "The recommended window was close to the cheapest"),
    "regret": ("EUR/MWh", "Recommended less cheapest mean"),
}
TYPES = {"string": "text", "int": "integer", "bigint": "integer", "double": "decimal", "date": "date", "timestamp": "datetime", "boolean": "true/false"}


def local_columns(df: DataFrame, cfg: LedgerConfig, ts: str = "slot_utc") -> DataFrame:
    local = t.local_ts(F.col(ts), cfg.tz)
    return df.withColumn("delivery_date_local", F.date_format(local, "yyyy-MM-dd")).withColumn(
        "delivery_time_local", F.date_format(local, "HH:mm")
    )


def four_decimals(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.4f", value))


def csv_text(df: DataFrame) -> DataFrame:
    """Columns as they appear in CSV: instants as UTC text, doubles with four decimals."""
    out = []
    for name, kind in df.dtypes:
        if kind == "timestamp":
            out.append(t.utc_text(F.col(name)).alias(name))
        elif kind in ("double", "float"):
            out.append(four_decimals(F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def export_forecasts(forecasts: DataFrame, cfg: LedgerConfig) -> DataFrame:
    df = local_columns(forecasts.withColumn("model_key", model_key()), cfg)
    return df.select(
        "series_id", "issue_date", "model_key", "horizon_days", "target_date",
        F.col("slot_utc").alias("delivery_start_utc"),
        "delivery_date_local", "delivery_time_local", "q10", "q50", "q90",
    )


def export_actuals(obs: DataFrame, cfg: LedgerConfig, since: Column | None = None) -> DataFrame:
    """``since`` limits the CSV to slots from that instant on; the Parquet export has all."""
    df = local_columns(obs, cfg)
    if since is not None:
        df = df.filter(F.col("slot_utc") >= since)
    return df.select(
        "series_id", F.col("slot_utc").alias("delivery_start_utc"),
        "delivery_date_local", "delivery_time_local", F.col("value").alias("price_eur_mwh"),
    )


def export_scores(scores: DataFrame, cfg: LedgerConfig) -> DataFrame:
    df = local_columns(scores.withColumn("model_key", model_key()), cfg)
    return df.select(
        "series_id", "model_key", "horizon_days", "issue_date", "target_date", F.col("slot_utc").alias("delivery_start_utc"),
        "delivery_date_local", "delivery_time_local", "status", "actual", "q10", "q50", "q90", "error", "abs_error", "sq_error", "pinball", "in_band",
    )


def export_daily(daily: DataFrame) -> DataFrame:
    return daily.select("series_id", "model_key", "horizon_days", "target_date", "issue_date", "status", "mae", "rmse", "pinball", "coverage_80", "n_slots")


def export_windows(judged: DataFrame) -> DataFrame:
    return judged.withColumn("model_key", model_key()).select(
        "series_id", "model_key", "horizon_days", "issue_date", "target_date", "status", "window_start_utc", "expected_mean", "p_cheapest", "p_near",
        "actual_best_start_utc", "actual_mean_recommended", "actual_mean_best", "actual_day_mean", "hit", "near", "regret",
    )


def commented(df: DataFrame) -> DataFrame:
    """Columns with their unit and comment as metadata, which Parquet files keep."""
    note = lambda c: {"unit": COMMENTS[c][0], "comment": COMMENTS[c][1]}
    return df.select(*[F.col(c).alias(c, metadata=note(c)) for c in df.columns])


def write_export(df: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """A table as Parquet and as CSV text, both as read back; raises if a row more or less is there than was written.

    The CSV is made from the Parquet files, so the two hold the same rows however the input is computed.
    """
    spark = df.sparkSession
    seen = Observation()
    commented(df).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("error").parquet(f"{path}/parquet")
    table = spark.read.parquet(f"{path}/parquet")
    text = csv_text(table)
    text.write.mode("error").option("header", True).csv(f"{path}/csv")
    back = spark.read.schema(text.schema).option("header", True).csv(f"{path}/csv")
    counts = {"written": seen.get["rows"], "Parquet": table.count(), "CSV": back.count()}
    if len(set(counts.values())) > 1:
        raise OSError(f"export at {path} is not whole: {counts}")
    return table, back


def data_dictionary(table: str, df: DataFrame) -> DataFrame:
    """A row for every column of an exported table: type and comment from its schema, and how many values are known."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    entries = [
        F.struct(
            F.lit(table).alias("table"),
            F.lit(field.name).alias("column"),
            F.lit(TYPES[field.dataType.simpleString()]).alias("type"),
            F.lit(field.metadata["unit"]).alias("unit"),
            F.lit(field.metadata["comment"]).alias("description"),
            F.col(field.name).alias("known_values"),
        )
        for field in df.schema
    ]
    return counts.select(F.inline(F.array(*entries)))


def latest_snapshot(forecasts: DataFrame, windows: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """Latest issue of every series as one nested row per model and target day."""
    latest = forecasts.groupBy("series_id").agg(F.max("issue_date").alias("issue_date"))
    rows = forecasts.join(latest, ["series_id", "issue_date"], "left_semi")
    two = lambda c: F.bround(c, 2)
    cells = rows.groupBy("series_id", "issue_date", "model", "model_version", "horizon_days", "target_date").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    t.utc_text(F.col("slot_utc")).alias("start_utc"),
                    t.local_iso(F.col("slot_utc"), cfg.tz).alias("start_local"),
                    two("q10").alias("q10"),
                    two("q50").alias("q50"),
                    two("q90").alias("q90"),
                )
            )
        ).alias("quarter_hours")
    )
    keys = ["series_id", "issue_date", "model", "model_version", "horizon_days", "target_date"]
    best = windows.select(*keys, F.struct("start_utc", "end_utc", "expected_mean", "p_cheapest", "p_near").alias("cheapest_window"))
    return cells.join(best, keys, "left")
