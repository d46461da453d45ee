"""Operator 6: quality rules with robust multivariate outliers.

Base rules reject texts with fewer than 20 words or with over 30 % of their words inside repeated 8-word windows. The texts that pass
give a vector of transformed statistics (word length, symbols, repeated lines, repeated words; short texts are shrunk towards
usual values). Per language and source the minimum covariance determinant estimate (the mean and covariance of the
tightest three quarters) is found by concentration steps, and a text whose Mahalanobis distance is beyond the chi-square cutoff is rejected.

Defined results: a null or empty text has no words and fails the base rules; a null language or source is a value of its own; groups
of fewer than ``MIN_GROUP`` texts are judged with the other small groups of their language, those languages that are still small all together, and
if even that is small nothing is rejected; repeated rows get equal verdicts.

Scale: one pass over texts; steps work on a table of four numbers per text. A step is one partial aggregate of moments per group and
distance bin (at most ``BINS`` a group), so a group with a third of all rows costs no more than any other rows. Bins decide which
texts a step keeps (all of the bin in which the three quarters are reached), which makes the estimate independent of the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slotledger.llm.common import documents, id_of, packed, stored, text_of

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\f\r"

#: Share of a group that the estimate rests on, and texts that a group needs.
CORE = 0.75
MIN_GROUP = 50
#: Chance of a normal text to be rejected.
TAIL = 1e-6
#: Concentration steps at most; they end when no determinant moves.
STEPS = 12
#: Distance bins: 16 per factor e, from e^-10 to e^20.
PER_E, BINS = 16, 480
#: Smallest standard deviation of each statistic: differences below it mean nothing.
FLOOR = (0.03, 0.25, 0.15, 0.12)
P = len(FLOOR)
CHI2_MEDIAN = 3.3567  # of four degrees of freedom


def counts_of(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word)."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return 0, 0, 0, 0, 0, 0
    seen: set[str] = set()
    dup = n_lines = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
            n_lines += 1
        elif line.strip(WHITE):
            seen.add(line)
            n_lines += 1
    return (
        len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words), n_lines,
    )


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.uint64, count=len(words))
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        key = key * np.uint64(0x94D049BB133111EB) + mixed[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + window, -1)
    return int((np.cumsum(steps) > 0).sum())


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "__n_lines")
_SCHEMA = "doc_id bigint, __id bigint, __crc bigint, __lang string, __source string, " + ", ".join(f"{c} bigint" for c in COUNTS)


def text_counts(docs: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [counts_of(t.as_py()) for t in b.column("__text")]
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * len(COUNTS))]
            keep = ["doc_id", "__id", "__crc", "__lang", "__source"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *columns], names=[*keep, *COUNTS])

    text = text_of(docs)
    return docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"), id_of(docs).alias("__id"), F.crc32(text.cast("binary")).alias("__crc"),
        docs["lang"].cast("string").alias("__lang"), docs["source"].cast("string").alias("__source"), text.alias("__text"),
    ).mapInArrow(count, _SCHEMA)


def vector() -> list[Column]:
    """The transformed statistics."""
    return [
        F.log((F.col("word_chars") + 500) / (F.col("n_words") + 100)),
        F.asinh(F.col("n_symbols") * 100 / (F.col("word_chars") + 100)),
        F.sqrt(F.col("n_dup_lines") / (F.col("__n_lines") + 5)),
        F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + 50)),
    ]


def grouped(rows: DataFrame) -> DataFrame:
    """Adds __group: language and source, or the pool that a small group falls into."""
    n = rows.groupBy("__lang", "__source").agg(F.count(F.lit(1)).alias("__n"))
    small = F.col("__n") < MIN_GROUP
    of_lang = F.sum(F.when(small, F.col("__n"))).over(W.partitionBy("__lang"))
    name = F.to_json(F.struct(F.lit(1).alias("k"), F.col("__lang").alias("l"), F.col("__source").alias("s")))
    pool = F.when(of_lang >= MIN_GROUP, F.to_json(F.struct(F.lit(2).alias("k"), F.col("__lang").alias("l")))).otherwise("rest")
    n = n.select(F.col("__lang").alias("__l"), F.col("__source").alias("__s"), F.when(~small, name).otherwise(pool).alias("__group"))
    return rows.join(n, F.col("__lang").eqNullSafe(F.col("__l")) & F.col("__source").eqNullSafe(F.col("__s"))).drop("__l", "__s")


_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance from columns x0.., mean m (array) and precision q (array of pairs)."""
    d = [F.col(f"x{i}") - F.get("m", F.lit(i)) for i in range(P)]
    terms = [d[i] * d[j] * F.get("q", F.lit(k)) * (1.0 if i == j else 2.0) for k, (i, j) in enumerate(_PAIRS)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.when(total.isNotNull(), F.greatest(total, F.lit(0.0)))


def distance_bin(d2: Column) -> Column:
    return F.least(F.greatest(F.floor(F.log(d2 + 4.6e-5) * PER_E).cast("int") + 10 * PER_E, F.lit(0)), F.lit(BINS))


def _solve(n: pd.Series, sums: pd.Series, products: pd.Series) -> pd.DataFrame:
    """Mean, precision and log determinant of each group from its moments."""
    out = []
    for count, s, pr in zip(n, sums, products, strict=True):
        mean = np.asarray(s, dtype=float) / count
        cov = np.zeros((P, P))
        for (i, j), v in zip(_PAIRS, pr, strict=True):
            cov[i, j] = cov[j, i] = v / count - mean[i] * mean[j]
        cov += np.diag(np.square(FLOOR))
        inv = np.linalg.inv(cov)
        out.append((mean.tolist(), [float(inv[i, j]) for i, j in _PAIRS], float(np.linalg.slogdet(cov)[1])))
    return pd.DataFrame(out, columns=["m", "q", "det"])


def estimate(vectors: DataFrame, core: float = CORE, steps: int = STEPS) -> DataFrame:
    """(__group, m, q, scale): MCD mean, precision and the factor that makes the median distance that of a normal group."""
    xs = [f"x{i}" for i in range(P)]
    solve = F.pandas_udf(_solve, "m array<double>, q array<double>, det double")
    middle = vectors.groupBy("__group").agg(*[F.percentile_approx(x, 0.5, 10000).alias(f"c{x}") for x in xs])
    spread = (
        vectors.join(middle, "__group").groupBy("__group")
        .agg(*[(F.percentile_approx(F.abs(F.col(x) - F.col(f"c{x}")), 0.5, 10000) * 1.4826).alias(f"s{x}") for x in xs])
    )
    diagonal = [
        F.lit(0.0) if i != j else 1 / (F.pow(f"sx{i}", F.lit(2.0)) + FLOOR[i] ** 2) for i, j in _PAIRS
    ]
    model = middle.join(spread, "__group").select(
        "__group", F.array(*[f"c{x}" for x in xs]).alias("m"), F.array(*diagonal).alias("q"), F.lit(None).cast("double").alias("det")
    )
    model = stored(model, "mcd")
    for step in range(steps + 1):
        placed = vectors.join(model, "__group").withColumn("__bin", distance_bin(distance()))
        bins = placed.groupBy("__group", "__bin").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(x).alias(f"s_{x}") for x in xs],
            *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p_{i}_{j}") for i, j in _PAIRS],
            F.max("det").alias("__det"),  # one a group: it comes with the model, so that the step needs no join with the last one
        )
        below = F.coalesce(F.sum("n").over(W.partitionBy("__group").orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        total = F.sum("n").over(W.partitionBy("__group"))
        bins = bins.withColumns({"__below": below, "__total": total})
        if step == steps:
            break
        inside = bins.where(F.col("__below") < core * F.col("__total")).groupBy("__group").agg(
            F.sum("n").alias("n"), *[F.sum(f"s_{x}").alias(f"s_{x}") for x in xs], *[F.sum(f"p_{i}_{j}").alias(f"p_{i}_{j}") for i, j in _PAIRS],
            F.max("__det").alias("__det"),
        )
        solved = inside.select(
            "__group",
            "__det",
            solve("n", F.array(*[f"s_{x}" for x in xs]), F.array(*[f"p_{i}_{j}" for i, j in _PAIRS])).alias("r"),
        ).select("__group", "r.m", "r.q", "r.det", "__det")
        seen = Observation()  # comes with the write: no query of its own
        new = stored(solved.observe(seen, F.max(F.coalesce(F.abs(F.col("det") - F.col("__det")), F.lit(1e9))).alias("moved")), "mcd")
        moved = seen.get["moved"]
        model = new.drop("__det")
        if moved is None or moved < 1e-9:
            steps = step + 1  # one more pass, for the median
            placed = vectors.join(model.select("__group", "m", "q"), "__group").withColumn("__bin", distance_bin(distance()))
            bins = placed.groupBy("__group", "__bin").agg(F.count(F.lit(1)).alias("n"))
            bins = bins.withColumns({"__below": below, "__total": total})
            break
    reached = F.when(F.col("__below") + F.col("n") >= 0.5 * F.col("__total"), F.exp((F.col("__bin") - 10 * PER_E + 1) / PER_E))
    scale = bins.groupBy("__group").agg((F.min(reached) / CHI2_MEDIAN).alias("scale"))
    return stored(model.join(scale, "__group").select("__group", "m", "q", "scale"), "mcd-scale")


def chi2_cutoff(tail: float = TAIL) -> float:
    """Value that a chi-square of four degrees of freedom exceeds with chance ``tail``."""
    low, high = 0.0, 1e4
    for _ in range(200):
        x = (low + high) / 2
        low, high = (x, high) if math.exp(-x / 2) * (1 + x / 2) > tail else (low, x)
    return high


def verdicts(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """doc_id, the counts, base_failed, kept, distance (scaled, null where no estimate applies); one row per document."""
    rows = stored(text_counts(docs), "text-counts")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    xs = {f"x{i}": c for i, c in enumerate(vector())}
    vectors = stored(grouped(rows.where("not base_failed")).withColumns(xs), "vectors")
    enough = vectors.groupBy("__group").count().where(F.col("count") >= MIN_GROUP).select("__group")
    # stored, since every step reads it: left to the plan, each one would count and join again
    model = estimate(stored(vectors.join(enough, "__group", "left_semi").select("__group", *xs), "enough-vectors"))
    # the floor of the scale keeps groups whose core is one point from rejecting small differences
    judged = vectors.join(model, "__group", "left").withColumn("distance", distance() / F.greatest("scale", F.lit(1.0)))
    good = F.coalesce(F.col("distance") <= chi2_cutoff(tail), F.lit(True))
    out = judged.select(*[c for c in rows.columns], "distance", good.alias("kept"))
    rejected = rows.where("base_failed").withColumns({"distance": F.lit(None).cast("double"), "kept": F.lit(False)})
    return out.unionByName(rejected)


def keep_good(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """The documents that pass."""
    bad = verdicts(docs, tail).where("not kept").select("__id", "__crc").distinct()
    return packed(docs).join(bad, ["__id", "__crc"], "left_anti").select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    out = verdicts(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 3).alias("distance"))
