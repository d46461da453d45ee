"""Operator 7: sources mixed to target weights along a tree of domain, language and source.

The token budget goes down the tree by weights. A node never gets more than its leaves can give (tokens times ``max_epochs``);
what it cannot take is shared among its siblings by their weights, and only what no sibling can take is missing at the level
above, where the same rule shares it among the parent's siblings. Each leaf's budget buys whole epochs and then a prefix
of one more epoch, in an order seeded by epoch and document.

Default weights are token shares to the power ``ALPHA`` at each level (below 1: smaller branches gain); a table of weights may be given.

Defined results: null language or source is a value of its own; sources without a trailing number are in the domain ``other``; a text without
words costs no token and is in a prefix like any other; rows that repeat an id and text are separate rows with equal keys, in
any order; an empty table gives no rows.

Scale: texts are read once for their word counts and never shuffled; prefix sums of a leaf are split into hash buckets,
so the leaf that holds a third of all rows is not one task; tables of nodes have a row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slotledger.llm.common import MAX_BUCKETS, WORD, documents, id_of, offsets, packed, stored, text_of

ALPHA = 0.7
MAX_EPOCHS = 2
SEED = "mix-1"
BUCKET = 20_000
#: Fixed tree: five consecutive source numbers make a domain, in turn.
DOMAINS = ("web", "books", "code", "forum")
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    number = F.nullif(F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1), F.lit("")).cast("bigint")
    place = F.floor(number / 5) % len(DOMAINS)
    name = F.lit(DOMAINS[-1])
    for i, domain in enumerate(DOMAINS[:-1]):
        name = F.when(place == i, domain).otherwise(name)
    return F.when(number.isNull(), "other").otherwise(name)


def slim(docs: DataFrame) -> DataFrame:
    text = text_of(docs)
    return docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"), id_of(docs).alias("__id"), F.crc32(text.cast("binary")).alias("__crc"),
        domain_of(docs["source"].cast("string")).alias("domain"), docs["lang"].cast("string").alias("lang"),
        docs["source"].cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("n_tokens"),
    )


def _same(a: list[str], right: str) -> Column:
    cond = F.lit(True)
    for c in a:
        cond = cond & F.col(c).eqNullSafe(F.col(right + c))
    return cond


def share_out(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``given`` to children (cap, weight, budget of the parent): each gets min(cap, level x weight), level by level.

    Sorted by cap / weight, children are full as long as an equal level would fill them; the rest share what is left.
    """
    order = W.partitionBy(*parent).orderBy("__full_at", "__name")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    rows = children.withColumn("__full_at", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    rows = rows.withColumn("__left", F.greatest(F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)), F.lit(0.0)))
    rows = rows.withColumn("__weights", F.sum("weight").over(after))
    rows = rows.withColumn("__level", F.when(F.col("__weights") > 0, F.col("__left") / F.col("__weights")).otherwise(0.0))
    full = (F.col("weight") > 0) & (F.col("__full_at") <= F.col("__level"))
    level = F.first(F.when(~full, F.col("__level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    given = F.when(full, F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return rows.withColumn("given", given).drop("__full_at", "__left", "__weights", "__level")


def leaf_budgets(leaves: DataFrame, total: float | None, alpha: float, max_epochs: int, weights: DataFrame | None) -> DataFrame:
    """Budget of each (domain, lang, source). ``total``: tokens, or null for as many as there are."""
    supply = leaves.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    supply = supply.withColumn("cap", F.col("tokens") * max_epochs)
    if weights is not None:
        supply = supply.join(F.broadcast(weights.select(*[F.col(c).alias(f"r_{c}") for c in LEVELS], F.col("weight").alias("asked"))), _same(list(LEVELS), "r_"), "left")
        supply = supply.withColumn("asked", F.coalesce("asked", F.lit(0.0))).withColumn("cap", F.when(F.col("asked") > 0, F.col("cap")).otherwise(0))
    all_tokens = F.sum("tokens").over(W.partitionBy(F.lit(1)))
    # a row per leaf: stored here and after each level, or one plan would hold the exchanges of all levels
    rows = stored(supply.withColumn("budget", (all_tokens if total is None else F.lit(total)).cast("double")), "mix-supply")
    for depth, name in enumerate(LEVELS):
        parent, keys = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        weight = F.sum("asked") if weights is not None else F.pow(F.sum("tokens").cast("double"), F.lit(alpha))
        nodes = rows.groupBy(*keys).agg(F.sum("cap").alias("cap"), weight.alias("weight"), F.max("budget").alias("budget"))
        nodes = share_out(nodes.withColumn("__name", F.coalesce(F.col(name), F.lit(""))), parent)
        nodes = nodes.select(*[F.col(k).alias(f"n_{k}") for k in keys], F.col("given"))
        rows = rows.join(nodes, _same(keys, "n_")).withColumn("budget", F.col("given")).drop("given", *[f"n_{k}" for k in keys])
        rows = stored(rows, "mix-level")
    return rows.select(*LEVELS, "tokens", F.floor(F.col("budget") + 1e-6).cast("bigint").alias("leaf_budget"))


def mix(docs: DataFrame, total: float | None = None, alpha: float = ALPHA, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
        weights: DataFrame | None = None) -> DataFrame:
    """Each document with its leaf's budget and ``copies``: how many epochs hold it (0: left out)."""
    rows = stored(slim(docs), "mix-rows")
    n = rows.count()
    buckets = max(1, min(MAX_BUCKETS, -(-n // BUCKET)))
    leaves = stored(leaf_budgets(rows, total, alpha, max_epochs, weights), "mix-leaves")
    leaves = leaves.withColumn("full", F.expr("if(tokens > 0, leaf_budget div tokens, 0)")).withColumn("rest", F.expr("if(tokens > 0, leaf_budget % tokens, 0)"))
    names = leaves.select(*[F.col(c).alias(f"r_{c}") for c in LEVELS], "leaf_budget", "full", "rest")
    rows = rows.join(names, _same(list(LEVELS), "r_")).drop(*[f"r_{c}" for c in LEVELS])
    rows = rows.withColumn("__key", F.md5(F.concat_ws(":", F.lit(seed), F.col("full"), F.col("__id"), F.col("__crc")).cast("binary")))
    rows = rows.withColumn("__bucket", F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("bigint") * buckets / 2**32).cast("int"))
    counts = rows.groupBy(*LEVELS, "__bucket").agg(F.sum("n_tokens").alias("__in"))
    counts = offsets(counts, list(LEVELS), "__bucket", "__in", "__before")
    counts = stored(counts.select(*[F.col(c).alias(f"r_{c}") for c in LEVELS], F.col("__bucket").alias("r___bucket"), "__before"), "mix-buckets")
    rows = rows.join(counts, _same([*LEVELS, "__bucket"], "r_"))
    upto = W.partitionBy(*LEVELS, "__bucket").orderBy("__key", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = F.col("__before") + F.sum("n_tokens").over(upto) <= F.col("rest")
    return rows.select(
        "doc_id", "__id", "__crc", *LEVELS, "n_tokens", "leaf_budget", (F.col("full") + inside.cast("bigint")).alias("copies")
    )


def materialise(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as its epochs hold it."""
    chosen = mix(docs, **options).where("copies > 0").select("__id", "__crc", "copies").dropDuplicates(["__id", "__crc"])
    chosen = stored(chosen, "mix-chosen")
    out = packed(docs).join(chosen.hint("merge"), ["__id", "__crc"])
    return out.select("__row", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("__id", "__crc")


def _level_sql(source: str, depth: int) -> str:
    keys, parent, name = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth]), LEVELS[depth]
    by = f"PARTITION BY {parent} " if parent else ""
    match = " AND ".join(f"x.{k} IS NOT DISTINCT FROM y.{k}" for k in LEVELS[: depth + 1])
    return f"""n{depth} AS (SELECT {keys}, sum(cap)::DOUBLE AS cap, pow(sum(tokens)::DOUBLE, {ALPHA}::DOUBLE) AS weight, max(budget) AS budget FROM {source} GROUP BY ALL),
a{depth} AS (SELECT *, greatest(budget - coalesce(sum(cap) OVER ({by}ORDER BY cap / weight, {name} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)
    / sum(weight) OVER ({by}ORDER BY cap / weight, {name} NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n{depth}),
g{depth} AS (SELECT {keys}, CASE WHEN cap / weight <= level THEN cap ELSE weight * max(CASE WHEN cap / weight > level THEN level END) OVER ({by}) END AS given FROM a{depth}),
b{depth + 1} AS (SELECT x.* REPLACE (y.given AS budget) FROM {source} x JOIN g{depth} y ON {match})"""


_LIST = "[" + ", ".join(f"'{d}'" for d in DOMAINS) + "]"
ORACLE_SQL = f"""WITH bytes AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, lang, source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(text), '..'), lambda h: CAST('0x' || h AS BIGINT))),
      lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS crc,
    coalesce({_LIST}[CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS BIGINT) // 5 % {len(DOMAINS)} + 1], 'other') AS domain
  FROM bytes, crc),
b0 AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {MAX_EPOCHS} AS cap,
    (SELECT sum(n_tokens) FROM d)::DOUBLE AS budget FROM d GROUP BY ALL),
{_level_sql("b0", 0)},
{_level_sql("b1", 1)},
{_level_sql("b2", 2)},
leaf AS (SELECT domain, lang, source, tokens, CAST(floor(budget + 1e-6::DOUBLE) AS BIGINT) AS leaf_budget FROM b3),
parts AS (SELECT *, CASE WHEN tokens > 0 THEN leaf_budget // tokens ELSE 0 END AS f, CASE WHEN tokens > 0 THEN leaf_budget % tokens ELSE 0 END AS rest FROM leaf),
keyed AS (SELECT d.*, p.leaf_budget, p.f, p.rest, md5('{SEED}:' || p.f || ':' || d.doc_id || ':' || d.crc) AS key FROM d
  JOIN parts p ON p.domain = d.domain AND p.lang IS NOT DISTINCT FROM d.lang AND p.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, domain, lang, source, n_tokens, leaf_budget, CAST(f AS BIGINT) + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS copies FROM keyed"""
