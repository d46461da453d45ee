"""Operator 4: threshold-scaled sketches as document fingerprints.

A text's shingles are its runs of five words (a shorter text: all its words). The sketch keeps every distinct shingle hash
below a fixed fraction (1/8) of the hash range. Sketches of one fraction merge by union, and intersections
estimate Jaccard likeness and containment between texts of any two sizes. The smallest hash of a text is always kept, so a
short text is never without a fingerprint. A text without words has the empty sketch.

Likeness of two sketches: shared hashes / hashes of both; of two empty ones 1, of an empty and another one 0.

Everything is a DataFrame expression. Texts are shuffled once, into ranges of ids, so that each meets its successor.

Defined results: null text: empty; repeated ids order by text; the last document's successor is the first (its own, if alone); an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slotledger.llm.common import documents, id_of, order_buckets, text_of, words_of

WORDS = 5
#: One hash of so many is kept.
SCALE = 8
#: Hashes are signed 64-bit numbers; those below this one are the kept fraction.
LIMIT = -(2**63) + 2**64 // SCALE


def sketch(text: Column, words: int = WORDS, limit: int = LIMIT) -> Column:
    """Sorted distinct kept hashes of a text."""
    hashed = F.transform(words_of(text), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        run = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)])
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0))), run)

    # a one-element array stands for a variable: each step is evaluated once
    every = F.get(F.transform(F.array(hashed), lambda h: F.when(F.size(h) > 0, shingles(h)).otherwise(F.array().cast("array<bigint>"))), 0)
    kept = lambda s: F.array_union(F.filter(s, lambda x: x < limit), F.array_compact(F.array(F.array_min(s))))
    return F.get(F.transform(F.array(every), lambda s: F.array_sort(kept(s))), 0)


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds; null for an empty a."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merge(a: Column, b: Column) -> Column:
    """Sketch of two texts together."""
    return F.array_sort(F.array_union(a, b))


def with_next(docs: DataFrame, *columns: str) -> DataFrame:
    """Adds __next_<column>: the value in the next row by ascending id, of the last row the first row's.

    Rows meet in ranges of ids. The first row of each range is copied into the range before it (of the first
    range: into the last one), so that no range needs its neighbour.
    """
    bucket, n = order_buckets(docs)
    rows = docs.withColumns({"__id": id_of(docs), "__bucket": bucket})
    firsts = rows.groupBy("__bucket").agg(F.min("__id").alias("__id"))  # a row per range, at most 65,536
    before = F.coalesce(F.lag("__bucket").over(W.orderBy("__bucket")), F.max("__bucket").over(W.partitionBy(F.lit(1))))
    firsts = firsts.select(F.col("__id").alias("__first"), before.alias("__into"))
    rows = rows.join(F.broadcast(firsts), F.col("__id") == F.col("__first"), "left")
    own = F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("extra"))
    copy = F.struct(F.col("__into").alias("b"), F.lit(True).alias("extra"))
    rows = rows.withColumn("__at", F.explode(F.when(F.col("__first").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    order = W.partitionBy("__at.b").orderBy("__at.extra", "__id", "text")
    out = rows.withColumns({f"__next_{c}": F.lead(c).over(order) for c in columns})
    return out.where("not __at.extra").drop("__bucket", "__first", "__into", "__at")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_hashes."""
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    rows = with_next(rows.withColumn("__sketch", sketch(F.col("text"))), "text", "__sketch")
    n = F.char_length("text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("__next_text"), F.lit(1), k))
    rows = rows.withColumn("__edited", edited)
    rows = rows.select(
        "doc_id", n.cast("bigint").alias("n_chars"), F.sha2(F.col("__edited"), 256).alias("edited_sha256"),
        "__sketch", "__next___sketch", sketch(F.col("__edited")).alias("__edited_sketch"),
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("__sketch")).alias("fingerprint"),
        as_text(F.col("__edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("__sketch"), F.col("__edited_sketch")).alias("near_edited"),
        likeness(F.col("__sketch"), F.col("__next___sketch")).alias("near_next"),
        F.size("__sketch").cast("bigint").alias("n_hashes"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
