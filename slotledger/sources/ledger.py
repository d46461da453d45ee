"""The write-once part of the ledger: forecasts, their manifests, and what may still be added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotledger.config import LedgerConfig
from slotledger.functions import timecols as t
from slotledger.models.requests import model_key
from slotledger.session import materialize
from slotledger.sources import commits

MODEL_KEYS = ["series_id", "issue_date", "model", "model_version"]
KEY_SCHEMA = "series_id string, issue_date date, model string, model_version string"

WINDOW_SCHEMA = (
    "struct<start_utc: string, end_utc: string, start_local: string, end_local: string, "
    "expected_mean: double, day_mean: double, p_cheapest: double, p_near: double, "
    "n_scenarios: int, most_likely: array<struct<start_utc: string, end_utc: string, "
    "start_local: string, end_local: string, p_cheapest: double>>>"
)
CUTOFF_SCHEMA = (
    "struct<description: string, fetched_at_utc: string, information_cutoff_utc: string, "
    "last_value_used_utc: string, last_value_available_utc: string, first_value_used_utc: string, "
    "n_values_used: bigint, archive_last_value_utc: string, filled_values: bigint, "
    "filled_days_local: array<string>, error: string, attribution: string>"
)
MANIFEST_SCHEMA = (
    "schema_version int, series_id string, model string, model_version string, "
    "model_description string, issue_date date, issued_at_utc string, issued_at_local string, "
    "target_dates array<string>, n_rows bigint, "
    f"data_cutoffs map<string, {CUTOFF_SCHEMA}>, "
    "package_version string, code_commit string, workflow_run_url string, parquet_sha256 string, "
    "cheapest_windows struct<method: string, window_hours: int, near_eur_mwh: double, "
    f"by_target: map<string, {WINDOW_SCHEMA}>>"
)


def todo(due: DataFrame, existing: DataFrame) -> DataFrame:
    """Due (series, issue, model) that have no forecast yet; existing ones are never redone."""
    return due.join(existing.select(*MODEL_KEYS).distinct(), MODEL_KEYS, "left_anti")


def issue_once(forecasts: DataFrame, path: str) -> str:
    """Add a run of forecasts to a write-once ledger; the name of the run.

    (series, issue, model) that the ledger holds are left out before anything is written. Two writers may still commit the same key at a
    time; the ledger then holds the rows of the commit that came first, all of them and no others, for every reader.
    """
    spark = forecasts.sparkSession
    run = commits.new_run()
    fresh = materialize(forecasts.join(held_runs(spark, path).select(*MODEL_KEYS), MODEL_KEYS, "left_anti"))
    keys = fresh.select(*MODEL_KEYS).distinct()
    if not keys.isEmpty():
        commits.write_run(fresh.repartition("issue_date"), path, run, ["issue_date"])
        commits.commit(keys, path, run)
    return run


def held_runs(spark: SparkSession, path: str) -> DataFrame:
    """(series, issue, model, run): the run whose rows count, the first that was committed for the key."""
    found = commits.read_commits(spark, path, KEY_SCHEMA)
    return found.groupBy(*MODEL_KEYS).agg(F.min(F.struct(*commits.SEQUENCE)).alias("c")).select(*MODEL_KEYS, "c.run")


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The forecasts of a write-once ledger; ``schema`` names the stored columns."""
    rows = commits.read_runs(spark, path, schema)
    return rows.join(held_runs(spark, path), [*MODEL_KEYS, "run"], "left_semi").drop("run")


def window_record(cfg: LedgerConfig) -> Column:
    """A recommended window as stored in a manifest: UTC and local text, probabilities."""

    def texts(start: Column, end: Column) -> list[Column]:
        return [
            t.utc_text(start).alias("start_utc"),
            t.utc_text(end).alias("end_utc"),
            t.local_iso(start, cfg.tz).alias("start_local"),
            t.local_iso(end, cfg.tz).alias("end_local"),
        ]

    return F.struct(
        *texts(F.col("start_utc"), F.col("end_utc")),
        "expected_mean",
        "day_mean",
        "p_cheapest",
        "p_near",
        "n_scenarios",
        F.transform(
            "most_likely",
            lambda m: F.struct(*texts(m["start_utc"], m["end_utc"]), m["p_cheapest"].alias("p_cheapest")),
        ).alias("most_likely"),
    )


def build_manifests(
    windows: DataFrame, issued: DataFrame, cutoffs: DataFrame | None, cfg: LedgerConfig, method: str = "scenario-errors.v1"
) -> DataFrame:
    """One nested record per (series, issue, model), its recommended windows keyed by target day.

    ``issued`` supplies ``issued_at_utc``, ``n_rows`` and ``parquet_sha256`` per forecast file.
    """
    per_target = windows.select(
        *MODEL_KEYS, F.date_format("target_date", "yyyy-MM-dd").alias("target"), window_record(cfg).alias("w")
    )
    grouped = per_target.groupBy(*MODEL_KEYS).agg(
        F.sort_array(F.collect_list("target")).alias("target_dates"),
        F.map_from_entries(F.collect_list(F.struct("target", "w"))).alias("by_target"),
    )
    out = grouped.join(issued, MODEL_KEYS)
    data_cutoffs = F.lit(None).cast(f"map<string, {CUTOFF_SCHEMA}>")
    if cutoffs is not None:
        out = out.join(cutoffs, ["series_id", "issue_date"], "left")
        data_cutoffs = F.col("data_cutoffs")
    return out.select(
        F.lit(1).alias("schema_version"),
        *MODEL_KEYS,
        t.utc_text(F.col("issued_at_utc")).alias("issued_at_utc"),
        t.local_iso(F.col("issued_at_utc"), cfg.tz).alias("issued_at_local"),
        "target_dates",
        "n_rows",
        data_cutoffs.alias("data_cutoffs"),
        "parquet_sha256",
        F.struct(
            F.lit(method).alias("method"),
            F.lit(cfg.window_hours).alias("window_hours"),
            F.lit(cfg.near_tolerance).alias("near_eur_mwh"),
            "by_target",
        ).alias("cheapest_windows"),
    )


def read_manifest_files(spark: SparkSession, path: str) -> DataFrame:
    """Manifest files with the folder they lie in; the schema is given, never inferred."""
    raw = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True)
    files = raw.option("pathGlobFilter", "*.json").json(path)
    return files.withColumn("file", F.col("_metadata.file_path"))


def manifest_windows(manifests: DataFrame) -> DataFrame:
    """Recommended windows of all manifests as one row per target day."""
    keys = [c for c in MODEL_KEYS if c in manifests.columns]
    exploded = manifests.select(*keys, "issued_at_utc", F.explode("cheapest_windows.by_target").alias("target", "w"))
    flat = exploded.select(*keys, "issued_at_utc", F.to_date("target").alias("target_date"), "w.*")
    return flat.withColumn("horizon_days", F.datediff("target_date", "issue_date"))


def inventory(manifests: DataFrame, missed: DataFrame) -> DataFrame:
    """Counts for release notes: files, issue days, first and last issue, missed forecasts."""
    files = manifests.agg(
        F.count("*").alias("forecast_files"),
        F.countDistinct("issue_date").alias("issue_days"),
        F.min("issue_date").alias("first_issue"),
        F.max("issue_date").alias("last_issue"),
    )
    return files.crossJoin(missed.agg(F.count("*").alias("missed_forecasts")))


def forecast_table(rows: DataFrame, issued_at: Column, cfg: LedgerConfig) -> DataFrame:
    """Stored layout of the forecasts, version 1."""
    return rows.select(
        F.lit(1).cast("smallint").alias("schema_version"),
        "series_id",
        "issue_date",
        issued_at.alias("issued_at_utc"),
        "model",
        "model_version",
        F.col("horizon_days").cast("tinyint").alias("horizon_days"),
        "target_date",
        F.col("slot_utc").alias("delivery_start_utc"),
        t.local_iso(F.col("slot_utc"), cfg.tz).alias("delivery_start_local"),
        F.lit(cfg.resolution).alias("resolution"),
        "q10",
        "q50",
        "q90",
    )


def with_model_key(df: DataFrame) -> DataFrame:
    return df.withColumn("model_key", model_key())
