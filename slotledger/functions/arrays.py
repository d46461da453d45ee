"""Helpers on arrays bounded by one local day or one error window (never by the panel)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def field_of(arr: Column | str, name: str) -> Column:
    """One field of every struct in an array."""
    return F.transform(arr, lambda e: e[name])


def present(arr: Column) -> Column:
    return F.filter(arr, lambda x: x.isNotNull())


def fill_in_order(arr: Column) -> Column:
    """Replace NULLs by the previous value in the array, leading NULLs by the next one."""

    def filled(x: Column, i: Column) -> Column:
        before = F.try_element_at(present(F.slice(arr, F.lit(1), i)), F.lit(-1))
        after = F.try_element_at(present(F.slice(arr, i + 2, F.size(arr))), F.lit(1))
        return F.coalesce(x, before, after)

    return F.when(F.exists(arr, lambda x: x.isNull()), F.transform(arr, filled)).otherwise(arr)


def array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def array_mean(arr: Column) -> Column:
    """Mean of the non-NULL elements, NULL if there are none."""
    return let(present(arr), lambda a: F.when(F.size(a) > 0, array_sum(a) / F.size(a)))


def sorted_quantile(arr: Column, q: float) -> Column:
    """Linear-interpolation quantile of an ascending array, NULL when it is empty."""
    pos = (F.size(arr) - 1) * F.lit(q)
    low = F.floor(pos).cast("int")
    v0 = F.get(arr, low)
    v1 = F.coalesce(F.get(arr, low + 1), v0)
    return F.when(F.size(arr) > 0, v0 + (v1 - v0) * (pos - low))


def by_bucket(values: Column, buckets: Column, n_buckets: int) -> Column:
    """Split a day array into ``n_buckets`` arrays of its non-NULL values by bucket number."""
    pairs = F.arrays_zip(buckets.alias("b"), values.alias("v"))
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_buckets - 1)),
        lambda k: F.transform(
            F.filter(pairs, lambda p: (p["b"] == k) & p["v"].isNotNull()), lambda p: p["v"]
        ),
    )


def window_means(arr: Column, width: int) -> Column:
    """Mean of each run of ``width`` consecutive elements."""
    return F.transform(
        F.sequence(F.lit(0), F.size(arr) - width),
        lambda i: array_sum(F.slice(arr, i + 1, F.lit(width))) / width,
    )


def first_argmin(arr: Column) -> Column:
    """0-based position of the smallest element, the earliest on ties."""
    return (F.array_position(arr, F.array_min(arr)) - 1).cast("int")
