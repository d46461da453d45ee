"""Refit days of the learned models, and fits that run side by side.

Anchors lie on a fixed grid of Sundays, so a live run and a replay of the same issue use the fit of the same anchor: the newest one at or
before the issue. An interval of seven days refits every week.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import date, timedelta
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A Sunday; anchors are whole intervals after it.
FIRST_SUNDAY = date(1970, 1, 4)
#: Fits submitted at a time; each is a distributed job of its own.
CONCURRENT_FITS = 8
#: Hourly rows of a task that prepares, scales or forecasts.
TABLE_ROWS = 50_000


def anchor_of(issue: Column, every: int) -> Column:
    """The newest anchor at or before an issue day."""
    back = F.pmod(F.date_diff(issue, F.lit(FIRST_SUNDAY)), F.lit(every))
    return F.date_sub(issue, back)


def anchors_between(first: date, last: date, every: int) -> list[date]:
    """Anchors that serve the issues from ``first`` to ``last``."""
    day = first - timedelta(days=(first - FIRST_SUNDAY).days % every)
    out = []
    while day <= last:
        out.append(day)
        day += timedelta(days=every)
    return out


def issue_span(asked: DataFrame) -> tuple[date, date] | None:
    """First and last issue day of the asked rows."""
    first, last = asked.agg(F.min("issue_date"), F.max("issue_date")).first()
    return None if first is None else (first, last)


def hourly_tasks(days: DataFrame) -> int:
    """Partitions for one hourly row per hour of the days.

    Fits are many short jobs, and every task sends its counters to the driver: at the session's number of shuffle partitions that would grow
    by fits times partitions, whatever the panel holds.
    """
    return max(1, -(-24 * days.count() // TABLE_ROWS))


def side_by_side(fit: Callable[..., Any], jobs: Iterable[tuple]) -> list[Any]:
    """``fit(*job)`` for each job, some at a time; the results in order."""
    with ThreadPoolExecutor(CONCURRENT_FITS) as pool:
        running = [pool.submit(inheritable_thread_target(fit), *job) for job in jobs]
        return [r.result() for r in running]
