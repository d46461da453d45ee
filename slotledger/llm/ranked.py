"""Ranked lexical search with MaxScore and pair bounds (operator 12).

1. Documents become inverted blocks, one row for some thousand documents: its terms, and for each the documents that hold it with
   their counts. Building needs no shuffle. Stored tables have a row group for each block, and tasks get a block at a time, so what a task
   holds is a few blocks, however many its part of a table has.
2. Collection figures (documents, terms, document frequencies of the query terms) are plain aggregates over the blocks.
3. The index adds to each block every term's largest impact and, for all pairs of the commonest query terms, the largest joint impact
   over the documents that hold both (their intersection). It is written once and serves any number of blocks of queries.
4. A query meets every block: terms are taken by falling bound while a document without them could still reach the threshold.
   The bound of a set of terms is the sum of their maxima less what pairs save: two matched terms count as their joint maximum (or the
   larger single one) instead of the sum. Scores of what is left are exact; a task keeps ten documents an item and so a rising threshold.

Defined cases
- A null or empty text has no terms: such a document is not counted, such an item has no rows. An empty table gives an empty result.
- Rows that repeat an item's id and text are one item; rows of one id with other texts are ranked apart, under the same id.
- Rows that repeat a document are ranked each, next to each other. A null ``doc_id`` counts as the smallest.
- Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slotledger.llm.common import SMALLEST, documents, id_of, stored, text_of

TOP = 10
#: Most documents and bytes of text of an inverted block.
BLOCK_ROWS = 4096
BLOCK_BYTES = 16 << 20
#: Blocks are rows of many megabytes: a row group holds one, else Spark's writers and readers hold a hundred or more at once.
ONE_A_GROUP = {"parquet.block.row.count.limit": 1}
#: Bytes after which a batch of rows goes to Python; Spark's own limit would gather several blocks in each task, there and here.
BATCH_BYTES = 4 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Postings whose impacts are computed at once.
IMPACTS = 1 << 17
#: Terms whose pairs have joint maxima.
PAIRED = 64
#: Most (item, term) entries of a block of queries: what a task holds of the query set.
QUERY_TERMS = 100_000
#: Largest vocabulary of a block of queries that is sent to all tasks.
BROADCAST_TERMS = 100_000

#: ASCII letters become small, all other ASCII but digits becomes a blank; bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


_BLOCK = pa.schema(
    [("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("df", pa.list_(pa.int32())),
     ("docs", pa.binary()), ("tf", pa.binary())]
)
BLOCK_DDL = "doc_ids array<bigint>, lengths array<bigint>, terms array<binary>, df array<int>, docs binary, tf binary"
INDEX_DDL = BLOCK_DDL + ", maxima array<bigint>, joint array<bigint>"


def _row(values: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values[f.name]], f.type) for f in schema], schema=schema)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, what the session writes or collects crosses to Python in small batches."""
    before = spark.conf.get(BATCH_LIMIT)
    spark.conf.set(BATCH_LIMIT, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH_LIMIT, before)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches, each as Python objects only while it is used."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _inverted(ids: list[int], counts: Iterable[Counter]) -> pa.RecordBatch:
    """A block of these documents; their counts are used one after the other and not kept."""
    place = defaultdict(count().__next__)
    codes, tf, sizes, lengths = array("i"), array("I"), [], []
    for found in counts:
        codes.extend(map(place.__getitem__, found))
        tf.extend(found.values())
        sizes.append(len(found))
        lengths.append(found.total())
    codes, tf = np.frombuffer(codes, np.int32), np.frombuffer(tf, np.uint32)
    docs = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
    order = np.argsort(codes, kind="stable")  # by term, then by document
    return _row(
        {"doc_ids": ids, "lengths": lengths, "terms": list(place), "df": np.bincount(codes, minlength=len(place)).astype(np.int32),
         "docs": docs[order].tobytes(), "tf": tf[order].tobytes()}, _BLOCK,
    )


def blocks(docs: DataFrame) -> DataFrame:
    """Inverted blocks of the documents that have terms."""

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                folded = text.as_py().translate(FOLD)
                if folded and not folded.isspace():
                    ids.append(doc)
                    texts.append(folded)
                    size += len(folded)
                if len(ids) >= BLOCK_ROWS or size >= BLOCK_BYTES:
                    yield _inverted(ids, (Counter(t.split()) for t in texts))
                    ids, texts, size = [], [], 0
        if ids:
            yield _inverted(ids, (Counter(t.split()) for t in texts))

    return stored(docs.select(id_of(docs).alias("id"), text_of(docs).alias("text")).mapInArrow(invert, BLOCK_DDL), "inverted", **ONE_A_GROUP)


def query_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items as (id, distinct terms), in blocks of bounded size."""
    found, size = [], 0
    for row in items.select("item_id", "text").distinct().toLocalIterator():
        terms = sorted(set(terms_of((row["text"] or "").encode())))
        if found and size + len(terms) > QUERY_TERMS:
            yield found
            found, size = [], 0
        if terms:
            found.append((row["item_id"], terms))
            size += len(terms)
    if found:
        yield found


def frequencies(inverted: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """Documents that hold each of these terms."""
    wanted = inverted.sparkSession.createDataFrame(pa.table({"term": pa.array(terms, pa.binary())}))
    if len(terms) <= BROADCAST_TERMS:
        wanted = F.broadcast(wanted)
    each = inverted.select(F.explode(F.arrays_zip("terms", "df")).alias("e")).select(F.col("e.terms").alias("term"), F.col("e.df").alias("df"))
    rows = each.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {bytes(r["term"]): r["df"] for r in rows}


class Block:
    """A block's postings with impacts, computed for the terms that are asked for."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.ids = np.array(row["doc_ids"], dtype=np.int64)
        self.m = 10 + (90 * np.array(row["lengths"], dtype=np.int64) * n_docs) // n_terms
        self.place = {t: i for i, t in enumerate(row["terms"])}
        self.starts = np.concatenate([[0], np.cumsum(row["df"], dtype=np.int64)])
        self.docs, self.tf = np.frombuffer(row["docs"], np.uint16), np.frombuffer(row["tf"], np.uint32)
        self.maxima, self.joint = row.get("maxima"), row.get("joint")
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def impacts(self) -> np.ndarray:
        """Of all postings, before weighting."""
        out = np.empty(len(self.tf), dtype=np.int64)
        for at in range(0, len(out), IMPACTS):
            tf, docs = self.tf[at : at + IMPACTS].astype(np.int64), self.docs[at : at + IMPACTS]
            out[at : at + IMPACTS] = (1_000_000_000 * tf) // (1000 * tf + 8 * self.m[docs])
        return out

    def postings(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts before weighting) of a term."""
        if place not in self.known:
            part = slice(self.starts[place], self.starts[place + 1])
            tf, docs = self.tf[part].astype(np.int64), self.docs[part].astype(np.int64)
            self.known[place] = docs, (1_000_000_000 * tf) // (1000 * tf + 8 * self.m[docs])
        return self.known[place]


def index(inverted: DataFrame, n_docs: int, n_terms: int, paired: list[tuple[bytes, int]]) -> DataFrame:
    """Blocks with each term's largest impact and the joint maxima of all pairs of the ``paired`` (term, weight)."""
    schema = _BLOCK.append(pa.field("maxima", pa.list_(pa.int64()))).append(pa.field("joint", pa.list_(pa.int64())))
    first, second = np.triu_indices(len(paired), 1)

    def enrich(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = Block(row, n_docs, n_terms)
            dense = np.zeros((len(paired), len(block.ids)), dtype=np.int64)
            for k, (term, weight) in enumerate(paired):
                if (at := block.place.get(term)) is not None:
                    docs, impacts = block.postings(at)
                    dense[k, docs] = weight * impacts
            joint = np.zeros(len(first), dtype=np.int64)
            for k in range(len(paired) - 1):  # the intersection of term k's list with each later one's
                both = (dense[k] > 0) & (dense[k + 1 :] > 0)
                joint[first == k] = np.where(both, dense[k] + dense[k + 1 :], 0).max(axis=1, initial=0)
            yield _row(row | {"maxima": np.maximum.reduceat(block.impacts(), block.starts[:-1]), "joint": joint}, schema)

    return stored(inverted.mapInArrow(enrich, INDEX_DDL), "ranked-index", **ONE_A_GROUP)


def pair_savings(block: Block, paired: list[tuple[bytes, int]]) -> np.ndarray:
    """What a bound falls by when two paired terms are taken together: sum of their maxima less their joint bound."""
    single = np.array([w * block.maxima[at] if (at := block.place.get(t)) is not None else 0 for t, w in paired], dtype=np.int64)
    saving = np.zeros((len(paired), len(paired)), dtype=np.int64)
    first, second = np.triu_indices(len(paired), 1)
    most = np.maximum(np.array(block.joint, dtype=np.int64), np.maximum(single[first], single[second]))
    saving[first, second] = saving[second, first] = single[first] + single[second] - most
    return saving


def prefix_bounds(bounds: np.ndarray, numbers: np.ndarray, saving: np.ndarray) -> np.ndarray:
    """Bound of the first i terms, for each i: sums of maxima less the savings of a matching among them.

    ``numbers`` has a term's place among the paired ones, or -1. A new term is matched with the unmatched one that saves most.
    """
    free: list[int] = []
    saved = np.zeros(len(bounds) + 1, dtype=np.int64)
    for i, k in enumerate(numbers):
        saved[i + 1] = saved[i]
        if k < 0:
            continue
        if free:
            gains = saving[k, free]
            best = int(gains.argmax())
            if gains[best] > 0:
                saved[i + 1] += gains[best]
                free.pop(best)
                continue
        free.append(int(k))
    return np.concatenate([[0], np.cumsum(bounds)]) - saved


class Searcher:
    """The best documents of each item over the blocks seen so far."""

    def __init__(self, items: list[list[tuple[bytes, int]]], paired: list[tuple[bytes, int]], top: int):
        self.items, self.paired, self.top = items, paired, top
        self.number = {t: k for k, (t, _) in enumerate(paired)}
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]  # scores, ids
        self.postings_read = 0

    def see(self, block: Block) -> None:
        saving = pair_savings(block, self.paired)
        for q, terms in enumerate(self.items):
            held = [(w * block.maxima[at], at, w, self.number.get(t, -1)) for t, w in terms if (at := block.place.get(t)) is not None]
            if held:
                self._rank(q, block, sorted(held), saving)

    def _rank(self, q: int, block: Block, held: list[tuple[int, int, int, int]], saving: np.ndarray) -> None:
        scores, ids = self.best[q]
        threshold = int(scores[-1]) if len(scores) == self.top else 1  # equal scores may still win by their id
        below = prefix_bounds(np.array([h[0] for h in held], dtype=np.int64), np.array([h[3] for h in held]), saving)
        if below[-1] < threshold:
            return
        total = np.zeros(len(block.ids), dtype=np.int64)
        live = None
        for i in range(len(held) - 1, -1, -1):
            if live is not None or below[i + 1] < threshold:
                # what holds none of the terms above i cannot get there with the first i + 1 terms alone
                live = np.flatnonzero((total > 0) & (total + below[i + 1] >= threshold)) if live is None else live[total[live] + below[i + 1] >= threshold]
                if not len(live):
                    return
            docs, impacts = block.postings(held[i][1])
            total[docs] += held[i][2] * impacts
            self.postings_read += len(docs)
        found = np.flatnonzero(total >= threshold) if live is None else live[total[live] >= threshold]
        scores, ids = np.concatenate([scores, total[found]]), np.concatenate([ids, block.ids[found]])
        order = np.lexsort((ids, -scores))[: self.top]
        self.best[q] = scores[order], ids[order]


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` highest-scoring documents of each item."""
    spark = docs.sparkSession
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long"
    with small_batches(spark):  # blocks, index and what is found are written within it
        inverted = blocks(docs)
        n_docs, n_terms = inverted.agg(F.sum(F.size("doc_ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()
        results = [_searched(inverted, block, n_docs, n_terms, top) for block in query_blocks(items)] if n_docs else []
    out = spark.createDataFrame([], schema)
    for found in results:
        out = out.unionAll(found.select(F.col("item_id").cast(items.schema["item_id"].dataType), "rank", "doc_id", "score"))
    return out


def _searched(inverted: DataFrame, items: list[tuple[int | None, list[bytes]]], n_docs: int, n_terms: int, top: int) -> DataFrame:
    spark = inverted.sparkSession
    df = frequencies(inverted, sorted({t for _, terms in items for t in terms}))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    paired = [(t, weight[t]) for t in sorted(df, key=lambda t: (-df[t], t))[:PAIRED]]
    queries = [[(t, weight[t]) for t in terms if weight.get(t, 0) > 0] for _, terms in items]
    written = index(inverted, n_docs, n_terms, paired)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(queries, paired, top)
        for row in rows_of(batches):
            searcher.see(Block(row, n_docs, n_terms))
        for q, (scores, ids) in enumerate(searcher.best):
            if len(ids):
                yield pa.RecordBatch.from_pydict({"q": pa.array(np.full(len(ids), q, np.int32)), "doc": pa.array(ids), "score": pa.array(scores)})

    found = stored(written.mapInArrow(rank, "q int, doc long, score long"), "ranked-found")
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "doc"))
    best = found.withColumn("rank", place).where(F.col("rank") <= top)
    ids = spark.createDataFrame(pa.table({"q": pa.array(range(len(items)), pa.int32()), "item_id": pa.array([i for i, _ in items], pa.int64())}))
    doc = F.when(F.col("doc") > SMALLEST, F.col("doc"))
    return best.join(F.broadcast(ids), "q").select("item_id", "rank", doc.alias("doc_id"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), counts AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), lengths AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id
), totals AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts WHERE term IN (SELECT term FROM asked) GROUP BY term), totals
), scored AS (
  SELECT item_id, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * n * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id), totals
  GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
