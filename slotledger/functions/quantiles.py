"""Exact quantiles of groups of any size, found by narrowing histograms instead of sorting a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FINE_BUCKETS = 1024


def _buckets_holding_rank(rows: DataFrame, keys: list[str], bucket: str, q: float | None) -> DataFrame:
    """Buckets that hold the two order statistics around the quantile, with the count below them."""
    hist = rows.groupBy(*keys, bucket).agg(
        F.sum("n").alias("in_bucket"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
        *([] if q is not None else [F.first("base").alias("base"), F.first("r0").alias("r0"), F.first("r1").alias("r1")]),
    )
    upto = F.sum("in_bucket").over(Window.partitionBy(*keys).orderBy(bucket))
    if q is not None:
        total = F.sum("in_bucket").over(Window.partitionBy(*keys))
        hist = hist.withColumn("upto", upto).withColumn("total", total)
        pos = (F.col("total") - 1) * F.lit(q)
        hist = hist.withColumn("pos", pos).withColumn("r0", F.floor("pos"))
        hist = hist.withColumn("r1", F.least(F.col("r0") + 1, F.col("total") - 1)).withColumn("base", F.lit(0))
    else:
        hist = hist.withColumn("upto", upto + F.col("base"))
    below = F.col("upto") - F.col("in_bucket")
    hit = (F.col("upto") > F.col("r0")) & (below <= F.col("r1"))
    return hist.withColumn("below", below).filter(hit)


def exact_quantile(
    df: DataFrame, keys: Sequence[str], value: str, q: float, out: str, weight: str | None = None
) -> DataFrame:
    """Linear-interpolation ``q`` quantile of the non-NULL values per group.

    ``weight`` names a column that says how often a row counts.

    Equal values collapse to counts first. A coarse histogram (logarithmic buckets) and a fine one
    (equal parts of one coarse bucket) locate the two ranks needed; only the values of those
    buckets are ever ordered. No task sees a whole group, however large one group is.
    """
    keys = list(keys)
    values = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("v"))
        .agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
        .withColumn("b1", F.floor(F.asinh("v") * 64))
    )
    coarse = _buckets_holding_rank(values, keys, "b1", q).select(
        *keys, "b1", "lo", "hi", F.col("below").alias("base"), "r0", "r1", "pos"
    )
    part = F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * FINE_BUCKETS)
    inside = values.join(coarse, [*keys, "b1"]).withColumn("b2", F.coalesce(part, F.lit(0)))
    fine = _buckets_holding_rank(inside.drop("lo", "hi"), [*keys, "b1"], "b2", None).select(
        *keys, "b1", "b2", F.col("below").alias("before")
    )
    last = inside.drop("base", "lo", "hi").join(fine, [*keys, "b1", "b2"])
    rank_to = F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "b1", "b2").orderBy("v"))
    ranked = last.withColumn("rank_to", rank_to).withColumn("rank_from", F.col("rank_to") - F.col("n"))
    holds = lambda r: (F.col("rank_from") <= F.col(r)) & (F.col(r) < F.col("rank_to"))
    picked = ranked.groupBy(*keys).agg(
        F.max(F.when(holds("r0"), F.col("v"))).alias("v0"),
        F.max(F.when(holds("r1"), F.col("v"))).alias("v1"),
        F.max(F.col("pos") - F.col("r0")).alias("frac"),
    )
    return picked.select(*keys, (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("frac")).alias(out))
