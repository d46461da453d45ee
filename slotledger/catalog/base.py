"""What the registered queries share: output helpers and the ledger built from the event panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotledger.bindings import panels as p
from slotledger.functions import timecols as t
from slotledger.plans import backtest as bt

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, if it has one, its SQL counterpart."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def r(col: Column | str, n: int = 6) -> Column:
    """Rounding for comparison: the nudge keeps exact halves off the edge, where the last bit of a
    sum would decide."""
    return F.round((F.col(col) if isinstance(col, str) else col) + F.lit(3e-4 * 10.0**-n), n) + F.lit(0.0)


def yes_no(col: Column | str) -> Column:
    """Nullable boolean as text."""
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def utc(col: str) -> Column:
    return t.utc_text(F.col(col))


def ev_days(spark: SparkSession, sf: str) -> DataFrame:
    return p.event_days(spark, sf, p.QUARTER)


def ev_scores(spark: SparkSession, sf: str, days: DataFrame | None = None) -> DataFrame:
    """Score rows of all rules over every day of the event panel."""
    return bt.naive_backtest(ev_days(spark, sf) if days is None else days, p.QUARTER, BACKTEST_SPECS)


def ev_scored_days(spark: SparkSession, sf: str, days: DataFrame | None = None) -> DataFrame:
    """The same scores packed by day."""
    return bt.naive_scored_days(ev_days(spark, sf) if days is None else days, p.QUARTER, BACKTEST_SPECS)


def ev_bands(spark: SparkSession, sf: str, days: DataFrame | None = None) -> DataFrame:
    return bt.naive_bands(ev_days(spark, sf) if days is None else days, p.QUARTER, BACKTEST_SPECS)


def ev_windows(spark: SparkSession, sf: str, days: DataFrame | None = None) -> DataFrame:
    return bt.naive_windows(ev_days(spark, sf) if days is None else days, p.QUARTER, BACKTEST_SPECS)


def backtest_specs():
    """A replay counts every observed day as due."""
    from dataclasses import replace

    return tuple(replace(s, live_since=None) for s in p.SHORT_SPECS)


BACKTEST_SPECS = backtest_specs()
