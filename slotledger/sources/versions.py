"""Month archives in versions: a month is rewritten where its content changed, readers see whole versions only.

A commit names its month, the run that holds the month's rows, and the run it was merged from. Read in order, a commit counts if
it was merged from the run that holds the month at its turn; one that was overtaken does not, for any reader, and its writer merges again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotledger.operators.observations import latest_wins
from slotledger.session import materialize
from slotledger.sources import commits
from slotledger.sources.archive import changed_months

COMMIT = "month string, base string, changed_rows bigint"
#: Merges of one delivery before the writer gives up against others.
TRIES = 10


class MonthArchive:
    """An archive of rows with a unique key, kept by ``month``.

    Where rows carry ``ingested_at`` the latest one wins, archived or fresh, otherwise the fresh one; a change of ``ingested_at`` alone is
    no change. ``schema``: keys, values and ``month``.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], values: Sequence[str]):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.values = list(keys), list(values)
        self.order = [c for c in ("ingested_at",) if c in self.values]
        self.compared = [c for c in self.values if c not in self.order]

    def holders(self) -> DataFrame:
        """(month, run, base, changed_rows): the run that holds each month now. One row a month; a month's commits meet in one row before."""
        found = commits.read_commits(self.spark, self.path, COMMIT)
        step = F.struct(*commits.SEQUENCE, "base", "changed_rows")
        nothing = F.lit(None).cast("struct<run: string, base: string, changed_rows: bigint>")
        held = F.aggregate(
            F.sort_array(F.collect_list(step)), nothing,
            lambda now, c: F.when(c["base"].eqNullSafe(now["run"]), F.struct(c["run"], c["base"], c["changed_rows"])).otherwise(now),
        )
        return found.groupBy("month").agg(held.alias("h")).select("month", "h.*")

    def read(self, holders: DataFrame | None = None) -> DataFrame:
        """The rows of all months, or of the months given with their holders. Folders of other runs and months are not opened."""
        held = self.holders() if holders is None else holders
        rows = commits.read_runs(self.spark, self.path, self.schema)
        return rows.join(F.broadcast(held.select("month", "run")), ["month", "run"]).drop("run")  # a row a month: bounded by the calendar

    def upsert(self, fresh: DataFrame) -> DataFrame:
        """Merge a delivery (with ``month``); the changed months with ``changed_rows``. Nothing is written where nothing changes."""
        columns = [*self.keys, *self.values, "month"]
        fresh = materialize(latest_wins(fresh.select(*columns), self.keys, [*self.order, *self.compared]))
        touched = fresh.select("month").distinct()
        done = None
        for _ in range(TRIES):
            won, lost = self._merge(fresh.join(touched, "month", "left_semi"), touched)
            done = won if done is None else done.unionByName(won)
            if lost.isEmpty():
                return done
            touched = lost
        raise RuntimeError(f"other writers kept overtaking this one at {self.path}")

    def _merge(self, fresh: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
        """One attempt: (months that changed and count, months overtaken by another writer)."""
        base = materialize(self.holders().join(touched, "month"))
        old = self.read(base)
        both = old.withColumn("rank", F.lit(0)).unionByName(fresh.withColumn("rank", F.lit(1)))
        merged = latest_wins(both, self.keys, [*self.order, "rank"]).drop("rank")
        changed = materialize(changed_months(old, merged, self.keys, self.compared))
        nobody = changed.limit(0).select("month")
        if changed.isEmpty():
            return changed, nobody
        run = commits.new_run()
        kept = merged.join(F.broadcast(changed.select("month")), "month", "left_semi")
        commits.write_run(kept.repartition("month"), self.path, run, ["month"])
        bases = changed.join(base.select("month", F.col("run").alias("base")), "month", "left")
        commits.commit(bases.select("month", "base", "changed_rows"), self.path, run)
        mine = materialize(changed.join(self._counted(run), "month", "left_semi"))
        return mine, changed.join(mine, "month", "left_anti").select("month")

    def _counted(self, run: str) -> DataFrame:
        """Months in which this run's commit counted: it holds them, or a later commit was merged from it."""
        found = commits.read_commits(self.spark, self.path, COMMIT)
        held = self.holders().filter(F.col("run") == run).select("month")
        return held.unionByName(found.filter(F.col("base") == run).select("month")).distinct()
