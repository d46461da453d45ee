"""Checks that make the ledger verifiable: manifests against files, and snapshots over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotledger.config import LedgerConfig
from slotledger.functions import timecols as t


def file_inventory(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Path and SHA-256 of every file below a folder."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.(json|parquet)$", "")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def outside_issue_window(issue: Column, issued_at: Column, cfg: LedgerConfig) -> Column:
    return (t.local_date(issued_at, cfg.tz) != issue) | ~t.in_issue_window(issued_at, cfg)


def manifest_audit(files: DataFrame, manifests: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """One row per violation: missing counterpart, changed content, wrong folder, issue time.

    ``files`` has ``path, sha256``; ``manifests`` has ``path, issue_date, issued_at_utc,
    parquet_sha256``. Both sides meet on the path without its extension.
    """
    left = files.select(stem(F.col("path")).alias("stem"), F.col("path").alias("file_path"), "sha256")
    right = manifests.select(
        stem(F.col("path")).alias("stem"),
        F.col("path").alias("manifest_path"),
        "issue_date",
        F.to_timestamp("issued_at_utc").alias("issued_at"),
        "parquet_sha256",
    )
    both = left.join(right, "stem", "full_outer")
    paired = F.col("file_path").isNotNull() & F.col("manifest_path").isNotNull()
    checks = F.array_compact(
        F.array(
            F.when(F.col("manifest_path").isNull(), "manifest missing"),
            F.when(F.col("file_path").isNull(), "file missing"),
            F.when(paired & ~F.col("sha256").eqNullSafe(F.col("parquet_sha256")), "content changed"),
            F.when(
                paired & (folder(F.col("file_path")) != F.date_format("issue_date", "yyyy-MM-dd")),
                "folder differs from issue date",
            ),
            F.when(
                paired & outside_issue_window(F.col("issue_date"), F.col("issued_at"), cfg),
                "issued outside the window",
            ),
        )
    )
    return both.select("stem", F.explode(checks).alias("violation"))


def immutability_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files of an earlier inventory that were modified (M) or deleted (D) since."""
    before = old.select("path", F.col("sha256").alias("was"))
    after = new.select("path", F.col("sha256").alias("now"))
    both = before.join(after, "path", "left")
    change = F.when(F.col("now").isNull(), "D").when(F.col("now") != F.col("was"), "M")
    return both.select("path", change.alias("change")).filter(F.col("change").isNotNull())
