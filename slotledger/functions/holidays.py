"""Nationwide public holidays and calendar features, computed from the date alone."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nationwide holidays as (month, day, name), and offsets in days from Easter Sunday.
FIXED_HOLIDAYS = (
    (1, 1, "New Year's Day"),
    (5, 1, "Labor Day"),
    (10, 3, "German Unity Day"),
    (12, 25, "Christmas Day"),
    (12, 26, "Second Day of Christmas"),
)
EASTER_HOLIDAYS = (
    (-2, "Good Friday"),
    (1, "Easter Monday"),
    (39, "Ascension Day"),
    (50, "Whit Monday"),
)
REFORMATION_JUBILEE = (2017, 10, 31, "Reformation Day")


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter (anonymous computus, Meeus/Jones/Butcher)."""
    div = lambda x, k: F.floor(x / k)
    a = year % 19
    b = div(year, 100)
    c = year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    m = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    n = h + m - 7 * div(a + 11 * h + 22 * m, 451) + 114
    return F.make_date(year.cast("int"), div(n, 31).cast("int"), (n % 31 + 1).cast("int"))


def holiday_name(day: Column) -> Column:
    """Name of the nationwide holiday or NULL; an Easter-based name yields to a fixed one."""
    year = F.year(day)
    since_easter = F.datediff(day, easter_sunday(year))
    name = None
    for month, dom, label in FIXED_HOLIDAYS:
        hit = (F.month(day) == month) & (F.dayofmonth(day) == dom)
        if (month, dom) == (10, 3):
            hit = hit & (year >= 1990)
        name = F.when(hit, label) if name is None else name.when(hit, label)
    y, m, d, label = REFORMATION_JUBILEE
    name = name.when(day == F.make_date(F.lit(y), F.lit(m), F.lit(d)), label)
    for offset, label in EASTER_HOLIDAYS:
        name = name.when(since_easter == offset, label)
    return name


def is_holiday(day: Column) -> Column:
    return holiday_name(day).isNotNull()


def calendar_features(day: Column) -> dict[str, Column]:
    """Weekday dummies (Sunday is the baseline), weekend and holiday flags, season."""
    angle = 2 * math.pi * F.dayofyear(day) / 365.25
    features = {f"dow{k}": (F.weekday(day) == k).cast("double") for k in range(6)}
    features["weekend"] = (F.weekday(day) >= 5).cast("double")
    features["holiday"] = is_holiday(day).cast("double")
    features["doy_sin"] = F.sin(angle)
    features["doy_cos"] = F.cos(angle)
    return features
