"""Tables that change while others read and write them: month archives in versions, write-once forecasts."""

import tempfile
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from slotledger import catalog
from slotledger.bindings import panels
from slotledger.catalog import integrity as audits
from slotledger.config import LedgerConfig
from slotledger.operators import integrity
from slotledger.sources import commits, files, ledger
from slotledger.sources.versions import MonthArchive

KEYS, VALUES = ["series_id", "slot"], ["value", "ingested_at"]
SCHEMA = "series_id string, slot int, value double, ingested_at timestamp, month string"
FORECASTS = "series_id string, issue_date date, model string, model_version string, q50 double"


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/table"


def rows(spark, *x):
    """(slot, value, day of ingestion[, month])."""
    return spark.createDataFrame([("s", r[0], r[1], datetime(2026, 1, r[2]), r[3] if len(r) > 3 else "2026-01") for r in x], SCHEMA)


def held(archive):
    return {(r["month"], r["slot"]): r["value"] for r in archive.read().collect()}


@pytest.fixture
def archive(spark):
    return MonthArchive(spark, folder(), SCHEMA, KEYS, VALUES)


def test_only_changed_months_are_rewritten(spark, archive):
    assert held(archive) == {}
    put = lambda *x: {r["month"]: r["changed_rows"] for r in archive.upsert(rows(spark, *x)).collect()}
    assert put((1, 10.0, 1), (1, 12.5, 2), (2, 5.0, 1), (3, 1.0, 1, "2026-02")) == {"2026-01": 2, "2026-02": 1}  # a delivery with copies
    before = {r["month"]: r["run"] for r in archive.holders().collect()}
    assert put((1, 11.0, 1)) == {}  # lands late
    assert put((2, 5.0, 9)) == {}  # the same value once more
    assert put((2, 6.0, 10), (3, 1.0, 9, "2026-02")) == {"2026-01": 1}
    after = {r["month"]: r["run"] for r in archive.holders().collect()}
    assert after["2026-02"] == before["2026-02"] and after["2026-01"] != before["2026-01"]
    assert held(archive) == {("2026-01", 1): 12.5, ("2026-01", 2): 6.0, ("2026-02", 3): 1.0}
    assert archive.upsert(rows(spark)).count() == 0


def test_a_commit_does_not_run_the_plan_before_it_in_one_task(spark):
    """One file all the same. Merged without an exchange, eight partitions would be computed, and hold their memory, in the writing task."""
    task = F.udf(lambda _: TaskContext.get().taskAttemptId(), "bigint")
    path, run = folder(), commits.new_run()
    commits.commit(spark.range(0, 8, 1, 8).select(F.col("id").cast("string").alias("month"), task("id").alias("task")), path, run)
    written = spark.read.parquet(f"{path}/commits/run={run}")
    assert len(written.inputFiles()) == 1 and written.count() == 8
    assert written.select("task").distinct().count() == 8


def test_readers_keep_their_version_and_never_see_a_dead_run(spark, archive):
    archive.upsert(rows(spark, (1, 1.0, 1)))
    reader = archive.read()
    dead = commits.new_run()
    commits.write_run(rows(spark, (1, 99.0, 9)), archive.path, dead, ["month"])  # it dies before its commit
    assert held(archive) == {("2026-01", 1): 1.0}
    archive.upsert(rows(spark, (1, 2.0, 2)))
    assert held(archive) == {("2026-01", 1): 2.0} and [r["value"] for r in reader.collect()] in ([1.0], [2.0])


def test_an_overtaken_commit_does_not_count(spark, archive):
    """Both merge from the same version; the second is ignored by readers and merges again."""
    archive.upsert(rows(spark, (1, 1.0, 1)))
    base = archive.holders().first()["run"]
    archive.upsert(rows(spark, (2, 2.0, 2)))
    late = commits.new_run()
    commits.write_run(rows(spark, (1, 1.0, 1), (3, 3.0, 3)), archive.path, late, ["month"])
    commits.commit(spark.createDataFrame([("2026-01", base, 1)], "month string, base string, changed_rows bigint"), archive.path, late)
    assert held(archive) == {("2026-01", 1): 1.0, ("2026-01", 2): 2.0}
    assert archive._counted(late).count() == 0 and archive._counted(base).count() == 1


def test_concurrent_writers_lose_nothing(spark, archive):
    deliveries = [rows(spark, (k, float(k), 2), (k + 10, float(k), 2, "2026-02")) for k in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda d: archive.upsert(d).count(), deliveries))
    assert held(archive) == {("2026-01", k): float(k) for k in range(4)} | {("2026-02", k + 10): float(k) for k in range(4)}


def test_other_months_are_not_opened(spark, archive):
    archive.upsert(rows(spark, *[(k, 1.0, 1, f"2026-{k:02d}") for k in range(1, 7)]))
    one = archive.read(archive.holders().filter("month = '2026-03'"))
    assert [r["slot"] for r in one.collect()] == [3]
    plan = one._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()


def test_forecasts_are_written_once(spark):
    path = folder()
    frame = lambda *x: spark.createDataFrame([("s", date(2026, 5, d), m, "1", v) for d, m, v in x], FORECASTS)
    read = lambda: sorted((r["issue_date"].day, r["model"], r["q50"]) for r in ledger.read_ledger(spark, path, FORECASTS).collect())
    assert read() == []
    ledger.issue_once(frame((1, "m", 1.0), (1, "m", 2.0)), path)
    ledger.issue_once(frame((1, "m", 9.0), (1, "n", 9.0)), path)
    ledger.issue_once(frame((1, "m", 8.0)), path)
    assert read() == [(1, "m", 1.0), (1, "m", 2.0), (1, "n", 9.0)]
    commits.write_run(frame((2, "m", 7.0)), path, commits.new_run(), ["issue_date"])  # dies before its commit
    assert read() == [(1, "m", 1.0), (1, "m", 2.0), (1, "n", 9.0)]


def test_two_writers_one_row_set(spark):
    """Writers that both found the key free: the first commit holds it, for every reader and for good."""
    path = folder()
    frame = lambda v: spark.createDataFrame([("s", date(2026, 5, d), "m", "1", v) for d in (1, 2) for _ in range(2)], FORECASTS)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda v: ledger.issue_once(frame(v), path), (1.0, 2.0)))
    runs = [commits.new_run() for _ in range(2)]
    for run, v in zip(runs, (3.0, 4.0), strict=True):  # certainly both: neither looks before it commits
        commits.write_run(frame(v), path, run, ["issue_date"])
        commits.commit(frame(v).select(*ledger.MODEL_KEYS).distinct(), path, run)
    first = ledger.read_ledger(spark, path, FORECASTS).groupBy("issue_date").agg(F.count("*").alias("n"), F.count_distinct("q50").alias("v"), F.max("q50").alias("q")).collect()
    assert len(first) == 2 and all((r["n"], r["v"]) == (2, 1) and r["q"] in (1.0, 2.0) for r in first)
    ledger.issue_once(frame(5.0), path)
    again = ledger.read_ledger(spark, path, FORECASTS).groupBy("issue_date").agg(F.max("q50").alias("q")).collect()
    assert {(r["issue_date"], r["q"]) for r in again} == {(r["issue_date"], r["q"]) for r in first}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packed_days_are_scanned_once_and_pruned(spark, sf):
    """Stored days: no raw scan in a plan, only the months and columns that are asked for."""
    table = panels.event_day_table(spark, sf)
    assert "events.parquet" not in plan_of(table) and panels.event_day_table(spark, sf).inputFiles() == table.inputFiles()
    last = table.agg(F.max("day")).first()[0]
    some = panels.between(table, last, last)
    scan = next(line for line in plan_of(some).splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(month" in scan and "PushedFilters: [IsNotNull(day)" in scan
    assert {r["day"] for r in some.collect()} == {last} and some.count() == table.filter(F.col("day") == F.lit(last)).count()
    names = next(line for line in plan_of(panels.event_days(spark, sf).select("series_id", "day")).splitlines() if "FileScan" in line)
    assert "values" not in names.split("ReadSchema:")[1]
    assert "values" not in plan_of(catalog.load()["latest_backtest"](spark, sf)) and "events.parquet" not in plan_of(catalog.load()["issue_forecasts"](spark, sf))


# ---------------------------------------------------------------- files


def test_files_tell_changes_moves_and_losses(spark):
    """Forecasts and manifests as files: equal rows give equal bytes in any order, one changed value does not; empty tables."""
    base = [("s %", date(2026, 1, d), m, "1", float(k)) for d in (1, 2, 3) for m in ("a", "b") for k in range(5)]
    schema = FORECASTS
    frame = lambda x: spark.createDataFrame(x, schema)
    one, two, three, none = folder(), folder(), folder(), folder()
    files.write_forecasts(frame(base).withColumn("model_version", F.lit("1")), one, ["q50"])
    files.write_forecasts(frame(base[::-1]).repartition(3), two, ["q50"])
    changed = [(*r[:4], r[4] + (1e-9 if r[1].day == 1 and r[2] == "a" and r[4] == 4 else 0)) for r in base if (r[1].day, r[2]) != (2, "b")]
    stray = F.when((F.col("model") == "a") & (F.col("issue_date") == "2026-01-03"), F.lit("2025-12-31").cast("date")).otherwise(F.col("issue_date"))
    files.write_forecasts(frame(changed), three, ["q50"], stray)
    hashes = lambda p: {r["path"]: r["sha256"] for r in files.forecast_hashes(spark, p).collect()}
    assert hashes(one) == hashes(two) and len(hashes(one)) == 6
    named = lambda p: "/".join(p.split("/")[1:])
    diff = integrity.immutability_diff(files.forecast_hashes(spark, one), files.forecast_hashes(spark, three))
    assert {(named(r["path"]), r["change"]) for r in diff.collect()} == {("2026-01-01/a.v1.parquet", "M"), ("2026-01-02/b.v1.parquet", "D"), ("2026-01-03/a.v1.parquet", "D")}
    facts = files.forecast_facts(spark, one, schema)
    assert {(r["issue_date"].day, r["model"], r["n_rows"], r["parquet_sha256"] == hashes(one)[r["path"]]) for r in facts.collect()} == {(d, m, 5, True) for d in (1, 2, 3) for m in "ab"}
    at = F.date_format("issue_date", "yyyy-MM-dd'T'09:00:00'Z'")
    manifests = folder()
    files.write_manifests(facts.drop("path").withColumn("issued_at_utc", at), manifests)
    back = files.read_manifests(spark, manifests)
    audit = integrity.manifest_audit(files.forecast_hashes(spark, three), back, LedgerConfig())
    found = {(named(r["stem"]), r["violation"]) for r in audit.collect()}
    assert found == {("2026-01-01/a.v1", "content changed"), ("2026-01-02/b.v1", "file missing"), ("2026-01-03/a.v1", "file missing"), ("2025-12-31/a.v1", "manifest missing")}
    assert integrity.manifest_audit(files.forecast_hashes(spark, one), back, LedgerConfig()).count() == 0
    files.write_forecasts(frame([]), none, ["q50"])
    assert hashes(none) == {} and files.forecast_facts(spark, none, schema).count() == 0


def test_files_list_one_encoding_a_column(spark):
    """A footer lists a column's encodings in an order that differs between executors: with more than one, equal rows are not equal bytes."""
    out = folder()
    rows = spark.range(200).selectExpr("'s' AS series_id", "DATE'2026-01-01' AS issue_date", "'m' AS model", "'1' AS model_version", "if(id = 7, NULL, id % 9 / 8D) AS q50", "timestamp_seconds(id) AS slot_utc", "id < 5 AS early")
    files.write_forecasts(rows, out, ["slot_utc"])
    (path,) = Path(out).rglob("*.parquet")
    group = pq.ParquetFile(path).metadata.row_group(0)
    assert group.num_columns == 7 and all(len(group.column(i).encodings) == 1 for i in range(7))
    back = spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(out)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()))


def test_audited_files_do_not_depend_on_the_executor(spark, sf):
    """The forecasts that ``manifest_audit`` hashes: no column of any file lists several encodings, not even in one file of them."""
    path, _ = audits.issued_files(spark, sf, audits.stray_day())
    found = [pq.ParquetFile(f).metadata.row_group(0) for f in Path(path).rglob("*.parquet")]
    assert len(found) > 100 and all(len(g.column(i).encodings) == 1 for g in found for i in range(g.num_columns))
