"""Two-sided Student t probability for whole degrees of freedom."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def t_two_sided(stat: Column, df: Column) -> Column:
    """P(|T| > |stat|) from the finite trigonometric series (Abramowitz & Stegun 26.7.3/26.7.4)."""
    theta = F.atan(F.abs(stat) / F.sqrt(df.cast("double")))
    sin, cos2 = F.sin(theta), F.cos(theta) * F.cos(theta)

    def series(count: Column, ratio) -> Column:
        """1 + sum of ``count`` further terms, each the previous one times ``ratio(k) cos^2``."""
        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
        step = lambda acc, k: F.struct(
            (acc["term"] * ratio(k) * cos2).alias("term"),
            (acc["total"] + acc["term"] * ratio(k) * cos2).alias("total"),
        )
        terms = F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(terms, start, step)["total"]

    k = df.cast("int")
    odd = (2 / math.pi) * (
        theta
        + F.when(
            k > 1,
            sin * F.cos(theta) * series(F.floor((k - 3) / 2).cast("int"), lambda j: 2.0 * j / (2.0 * j + 1.0)),
        ).otherwise(0.0)
    )
    even = sin * series(F.floor((k - 2) / 2).cast("int"), lambda j: (2.0 * j - 1.0) / (2.0 * j))
    return 1.0 - F.when(k % 2 == 1, odd).otherwise(even)
