"""Operator 9: documents packed into sequences by length patterns.

Documents are encoded (an end id closes each); those longer than a sequence are cut into full pieces, the first of them
the remainder. The histogram of piece lengths (at most 1,024 numbers) decides a plan of length patterns and repeats, see
``packing_plan``. Each piece finds its place from its length and its rank among the pieces of that length.

Defined results: a null or empty text is one piece holding the end id; repeated rows are packed as separate pieces; an empty table
gives no rows.

Scale: ids never leave the task that encodes a text; rows of a few numbers are ranked within length and hash bucket, so the commonest
length is split; the plan is sent to the tasks and is bounded by the sequence length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slotledger.llm import tokens
from slotledger.llm.common import documents, id_of, offsets, stored
from slotledger.llm.packing_plan import plan

END = 2
SIZE = 1024
BUCKET = 20_000


def pieces(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None) -> DataFrame:
    """doc_id, __id, piece, start, length, ids_crc32."""
    path = vocabulary or tokens.vocabulary()
    kinds = {"doc_id": pa.int64(), "__id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.append(tokens.ids_of(text.as_py(), path), np.uint32(END)).astype("<u4")
                at, n = 0, len(ids) % size or size
                for p in range(-(-len(ids) // size)):
                    rows.append((doc_id, key, p, at, n, zlib.crc32(ids[at : at + n].tobytes())))
                    at, n = at + n, size
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    source = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), id_of(docs).alias("__id"), "text")
    schema = "doc_id bigint, __id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return stored(source.mapInArrow(cut, schema), "pieces")


def places(hist: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Runs of equal pieces, sorted by length and rank: key (length and first rank), first sequence, offset."""
    todo = [*plan(np.where(np.arange(size + 1) < size, hist, 0), size), ((size,), int(hist[size]))]
    given = np.zeros(size + 1, dtype=np.int64)
    keys, firsts, offs = [], [], []
    sequence = 0
    for kind, n in todo:
        at = 0
        for length in kind:
            keys.append((length << 45) | int(given[length]))
            firsts.append(sequence)
            offs.append(at)
            given[length] += n
            at += length
        sequence += n
    order = np.argsort(np.array(keys, dtype=np.int64))
    return {name: np.array(x, dtype=np.int64)[order] for name, x in (("key", keys), ("first", firsts), ("offset", offs))}


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    rows = pieces(docs, size, vocabulary)
    hist = np.zeros(size + 1, dtype=np.int64)
    for length, n in rows.groupBy("length").count().collect():  # at most ``size`` numbers
        hist[length] = n
    runs = places(hist, size)
    buckets = max(1, int(hist.sum()) // BUCKET)
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("__id"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__in"))
    counts = offsets(counts, ["length"], "__bucket", "__in", "__before").select("length", "__bucket", "__before")
    order = W.partitionBy("length", "__bucket").orderBy("__id", "piece", "ids_crc32")
    rows = rows.join(counts, ["length", "__bucket"]).withColumn("__rank", F.col("__before") + F.row_number().over(order) - 1)
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            key = (f["length"].to_numpy(np.int64) << 45) | f["__rank"].to_numpy(np.int64)
            run = np.searchsorted(runs["key"], key, side="right") - 1
            f["sequence_id"] = runs["first"][run] + key - runs["key"][run]
            f["offset"] = runs["offset"][run]
            yield f.drop(columns="__rank")

    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "__rank").mapInPandas(place, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
