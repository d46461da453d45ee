"""Audit of manifests and of inventories over time, on files that the query wrote from the event panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotledger.bindings import panels as p
from slotledger.catalog import reports as rep
from slotledger.catalog import sql as q
from slotledger.catalog.base import ev_bands, query
from slotledger.functions import timecols as t
from slotledger.operators import bands, integrity
from slotledger.session import shared_folder
from slotledger.sources import files
from slotledger.sources.commits import stored_schema

CFG = p.QUARTER
ROW_ORDER = ("horizon_days", "slot_utc")
#: One issue of one model lies in the folder of this day.
STRAY = "2023-12-01"


def stray_day():
    return F.when((F.col("model") == "naive_last_day") & (F.col("issue_date") == "2024-01-10"), F.lit(STRAY).cast("date")).otherwise(F.col("issue_date"))


def issued_files(spark, sf, filed_on=None):
    """The forecasts of the event panel written as files; their root and the schema of their rows."""
    rows = bands.forecast_rows(ev_bands(spark, sf), CFG)
    path = shared_folder(spark, "forecasts")
    files.write_forecasts(rows, path, ROW_ORDER, filed_on)
    return path, stored_schema(rows)


def rewritten(spark, path, schema, changed_model, kept, filed_on=None):
    """A later state of the files: one model's values moved by a hundredth, issues outside ``kept`` gone, the rest written as it was."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path).filter(kept)
    later = shared_folder(spark, "forecasts")
    moved = F.when(F.col("model") == changed_model, F.col("q50") + 0.01).otherwise(F.col("q50"))
    files.write_forecasts(rows.withColumn("q50", moved), later, ROW_ORDER, filed_on)
    return later


_FILES = [
    *q.ev_base(),
    f"""files AS (SELECT DISTINCT series_id, issue_date, model, model = 'naive_last_day' AND issue_date = DATE '2024-01-10' AS stray,
    series_id || '/' || strftime(issue_date, '%Y-%m-%d') || '/' || model || '.v1' AS filed, series_id || '/' || CASE WHEN stray THEN '{STRAY}' ELSE strftime(issue_date, '%Y-%m-%d') END || '/' || model || '.v1' AS stem FROM fc)""",
]


@query(
    "manifest_audit",
    q.with_(
        *_FILES, rep.ISSUED,
        # manifests of the first issue days carry no file, one issue day is stated four hours early
        "mani AS (SELECT f.*, CASE WHEN f.issue_date = DATE '2024-01-12' THEN i.at_s - 14400 ELSE i.at_s END AS at_s FROM files f JOIN issued i ON i.series_id = f.series_id AND i.issue_date = f.issue_date)",
        "kept AS (SELECT * FROM files WHERE issue_date > DATE '2024-01-04')",
        f"""v AS (SELECT coalesce(k.stem, m.stem) AS stem, unnest([CASE WHEN m.stem IS NULL THEN 'manifest missing' END, CASE WHEN k.stem IS NULL THEN 'file missing' END,
      CASE WHEN k.stem IS NOT NULL AND m.stem IS NOT NULL AND m.model = 'naive_weekly' THEN 'content changed' END,
      CASE WHEN k.stem IS NOT NULL AND m.stem IS NOT NULL AND m.stray THEN 'folder differs from issue date' END,
      CASE WHEN k.stem IS NOT NULL AND m.stem IS NOT NULL AND strftime({q.local('m.at_s')}, '%H:%M') NOT BETWEEN '08:45' AND '11:59' THEN 'issued outside the window' END]) AS violation
    FROM kept k FULL JOIN mani m ON m.stem = k.stem)""",
    )
    + "SELECT stem, violation FROM v WHERE violation IS NOT NULL",
)
def manifest_audit(spark, sf):
    """Forecasts and manifests written, then the files of one model changed, the first days lost, one issue misfiled and one day early."""
    path, schema = issued_files(spark, sf, stray_day())
    issued = rep.ev_issued(spark, sf)
    early = F.when(F.col("issue_date") == "2024-01-12", F.col("issued_at_utc") - F.expr("INTERVAL 4 HOURS")).otherwise(F.col("issued_at_utc"))
    stated = files.forecast_facts(spark, path, schema).join(issued, ["series_id", "issue_date"]).withColumn("issued_at_utc", t.utc_text(early)).drop("path")
    manifests = shared_folder(spark, "manifests")
    files.write_manifests(stated, manifests, stray_day())
    found = rewritten(spark, path, schema, "naive_weekly", F.col("issue_date") > "2024-01-04", stray_day())
    return integrity.manifest_audit(files.forecast_hashes(spark, found), files.read_manifests(spark, manifests), CFG)


@query(
    "immutability_diff",
    q.with_(*_FILES)
    + """SELECT filed || '.parquet' AS path, CASE WHEN issue_date >= DATE '2024-01-25' THEN 'D' ELSE 'M' END AS change FROM files
WHERE issue_date >= DATE '2024-01-25' OR model = 'naive_last_day'""",
)
def immutability_diff(spark, sf):
    """Hashes of the files against those of a later state without the newest issues and with one model rewritten."""
    path, schema = issued_files(spark, sf)
    later = rewritten(spark, path, schema, "naive_last_day", F.col("issue_date") < "2024-01-25")
    return integrity.immutability_diff(files.forecast_hashes(spark, path), files.forecast_hashes(spark, later))
