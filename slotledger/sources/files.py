"""Forecasts and manifests as files of their own, and what can be read off the files alone.

A forecast is one folder ``series=../day=../name=..`` with its rows as Parquet in a fixed order, so equal forecasts are equal bytes; its
manifest is a JSON file in a folder of the same name below another root. ``day`` is where the forecast was filed, the issue day unless
a caller says otherwise. Empty tables write no folders and read back as no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotledger.models.requests import model_key
from slotledger.sources.ledger import CUTOFF_SCHEMA, MANIFEST_SCHEMA, MODEL_KEYS

FOLDERS = ("series", "day", "name")
#: One encoding a column. A footer lists the encodings of a column as an unordered set, in an order that differs between executors,
#: so with several of them (dictionary and plain, levels of first-version pages) equal rows would be different bytes.
ONE_ENCODING = {"parquet.enable.dictionary": "false", "parquet.writer.version": "v2"}


def _filed(rows: DataFrame, filed_on: Column | None) -> DataFrame:
    """Folder columns that are never NULL: the writer sorts again, by folder alone, where they may be."""
    day = F.col("issue_date") if filed_on is None else filed_on
    folders = {"series": F.col("series_id"), "day": F.date_format(day, "yyyy-MM-dd"), "name": model_key()}
    return rows.withColumns({name: F.coalesce(c, F.lit("")) for name, c in folders.items()})


def write_forecasts(rows: DataFrame, path: str, order: Sequence[str], filed_on: Column | None = None) -> None:
    """One folder for each (series, issue, model); ``order`` names the columns that order the rows of a forecast.

    All columns are stored as optional: whether a plan knows that a column has no NULL, as of a literal, must not show in the bytes. The
    condition below always holds, but no plan knows that.
    """
    optional = rows.select(*[F.when(F.monotonically_increasing_id() >= 0, F.col(c)).alias(c) for c in rows.columns])
    filed = _filed(optional, filed_on).repartition(*FOLDERS).sortWithinPartitions(*FOLDERS, *order)
    filed.write.mode("error").options(**ONE_ENCODING).partitionBy(*FOLDERS).parquet(path)


def write_manifests(manifests: DataFrame, path: str, filed_on: Column | None = None) -> None:
    """One JSON file for each manifest."""
    filed = _filed(manifests, filed_on).repartition(*FOLDERS)
    filed.write.mode("error").partitionBy(*FOLDERS).json(path)


def filed_as(suffix: str) -> Column:
    """``series/day/name`` and a suffix, from the place of the file a row was read from; names as the store writes them."""
    part = lambda c: F.regexp_extract(F.col("_metadata.file_path"), rf"/{c}=([^/]+)/", 1)
    return F.concat(F.concat_ws("/", *[part(c) for c in FOLDERS]), F.lit(suffix))


def forecast_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256`` of every forecast, from the bytes of its files: the hash of one file, or of the ordered hashes of several."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    files = raw.select(filed_as(".parquet").alias("path"), F.sha2("content", 256).alias("sha"))
    hashes = files.groupBy("path").agg(F.sort_array(F.collect_list("sha")).alias("s"))
    return hashes.select("path", F.when(F.size("s") == 1, F.col("s")[0]).otherwise(F.sha2(F.concat_ws(",", "s"), 256)).alias("sha256"))


def forecast_facts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a manifest states about its forecast, read off the files: key, ``n_rows``, ``parquet_sha256`` and the ``path``."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    counted = rows.groupBy(filed_as(".parquet").alias("path"), *MODEL_KEYS).agg(F.count("*").alias("n_rows"))
    return counted.join(forecast_hashes(spark, path).withColumnRenamed("sha256", "parquet_sha256"), "path")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests with the ``path`` they are filed under."""
    raw = spark.read.schema(MANIFEST_SCHEMA).option("recursiveFileLookup", True).json(path)
    return raw.withColumn("path", filed_as(".json"))


def cutoff_map(cutoffs: DataFrame, source: str, description: str) -> DataFrame:
    """``cutoff_metadata`` rows as the map a manifest carries: one entry, named by its source."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    known = {
        "description": F.lit(description),
        "information_cutoff_utc": text("information_cutoff_utc"),
        "first_value_used_utc": text("first_value_used_utc"),
        "last_value_used_utc": text("last_value_used_utc"),
        "n_values_used": F.col("n_values_used"),
    }
    fields = [f.split(":")[0].strip() for f in CUTOFF_SCHEMA.removeprefix("struct<").removesuffix(">").split(", ")]
    entry = F.struct(*[known.get(f, F.lit(None)).alias(f) for f in fields]).cast(CUTOFF_SCHEMA)
    return cutoffs.select("series_id", "issue_date", F.create_map(F.lit(source), entry).alias("data_cutoffs"))
