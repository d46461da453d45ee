"""Ranked search against plain loops."""

import math
import re
import tracemalloc
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from slotledger.llm import common, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=10):
    counts = [(i if i is not None else -(2**63), Counter(words(t))) for i, t in docs if words(t)]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        terms = set(words(text)) & set(df)
        scores = []
        for doc, c in counts:
            m = 10 + 90 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, doc))
        out += [(item, rank, doc if doc > -(2**63) else None, -s) for rank, (s, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def run(frame, spark, docs, items, **options):
    got = ranked.search(frame(docs, **options), spark.createDataFrame(items, ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


def test_given_rows(frame, spark, small, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_ROWS", 16)  # many blocks: thresholds and bounds matter
    docs = [r[:2] for r in small[:150]]
    items = [(r[0], r[1][:300]) for r in small[:150:11]] + [(900, "the and of"), (901, "none-such"), (902, docs[3][1])]
    assert run(frame, spark, docs, items, parts=2) == brute(docs, items)


def test_odd_rows(frame, spark, odd):
    items = [(1, "a repeated Row"), (1, "a repeated Row"), (1, "WÖRDS wörds"), (2, None), (3, ""), (None, "some null words"), (4, "word other")]
    assert run(frame, spark, odd, items, clash=True) == brute([r[:2] for r in odd], items)


def test_empty_tables(frame, spark):
    assert run(frame, spark, [], [(1, "word")]) == [] and run(frame, spark, [(1, "word")], []) == []
    assert run(frame, spark, [(1, None), (2, " . ")], [(1, "word")]) == []


def test_queries_in_blocks(frame, spark, small, monkeypatch):
    monkeypatch.setattr(ranked, "QUERY_TERMS", 40)
    docs, items = [r[:2] for r in small[:40]], [(r[0], r[1][:150]) for r in small[:6]]
    assert run(frame, spark, docs, items) == brute(docs, items)


def test_a_row_group_holds_one_block(frame, spark, small, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_ROWS", 16)
    inverted = ranked.blocks(frame([r[:2] for r in small[:150]], parts=1))
    for table in (inverted, ranked.index(inverted, 150, 10**5, [(b"the", 1)])):
        files = [pq.ParquetFile(urlparse(f).path).metadata for f in table.inputFiles()]
        assert sum(f.num_rows for f in files) >= 9 and all(f.num_row_groups == f.num_rows for f in files)


def test_steps_over_blocks_run_with_small_batches(frame, spark, small, monkeypatch):
    seen, before = {}, spark.conf.get(ranked.BATCH_LIMIT)

    def stored(df, name, **options):
        seen[name] = int(spark.conf.get(ranked.BATCH_LIMIT).rstrip("b"))
        return common.stored(df, name, **options)

    monkeypatch.setattr(ranked, "stored", stored)
    docs, items = [r[:2] for r in small[:20]], [(1, small[3][1][:200])]
    assert run(frame, spark, docs, items) == brute(docs, items)
    assert seen == dict.fromkeys(("inverted", "ranked-index", "ranked-found"), ranked.BATCH_BYTES)
    assert spark.conf.get(ranked.BATCH_LIMIT) == before


def test_large_rows_cross_one_by_one(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    rows = spark.range(0, 12, 1, 1).select(F.repeat(F.lit("x"), 5 << 20).cast("binary").alias("docs"))
    with ranked.small_batches(spark):
        assert [r["n"] for r in rows.mapInArrow(sizes, "n long").collect()] == [1] * 12


def peak_of(run):
    tracemalloc.start()
    run()
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    return most


def test_a_batch_becomes_objects_row_by_row():
    batch = pa.RecordBatch.from_pydict({"docs": pa.array([bytes(1 << 20)] * 40)})
    assert sum(len(r["docs"]) for r in ranked.rows_of([batch])) == 40 << 20
    assert peak_of(lambda: [None for _ in ranked.rows_of([batch])]) < 4 << 20


def test_terms_of_a_block_are_not_kept_as_objects():
    rng = np.random.default_rng(1)
    texts = [b" ".join(b"w%d" % n for n in rng.integers(0, 20_000, 2_000)) for _ in range(200)]
    assert peak_of(lambda: ranked._inverted(list(range(200)), (Counter(ranked.terms_of(t)) for t in texts))) < 8 * sum(map(len, texts))
    assert peak_of(lambda: [Counter(ranked.terms_of(t)) for t in texts]) > 8 * sum(map(len, texts))


def test_impacts_need_little_beside_themselves():
    n = 1 << 20
    row = {"doc_ids": [1, 2], "lengths": [900, 70], "terms": [b"a"], "df": [n], "docs": np.tile(np.array([0, 1, 0], np.uint16), n)[:n].tobytes(),
           "tf": (np.arange(n, dtype=np.uint32) % 977 + 1).tobytes()}
    block = ranked.Block(row, 2, 970)
    docs, want = block.postings(0)
    assert (block.impacts() == want).all() and len(docs) == n
    assert peak_of(block.impacts) < 2 * want.nbytes


@pytest.mark.parametrize("seed", range(5))
def test_pair_bounds_hold_and_skip(seed):
    """The bound of every prefix is at least what any document scores in it, and below the sum of maxima where pairs save."""
    rng = np.random.default_rng(seed)
    terms = [b"t%d" % k for k in range(12)]
    counts = [Counter({t: int(n) for t, n in zip(terms, rng.poisson(0.7, 12), strict=True) if n} or {terms[0]: 1}) for _ in range(300)]
    row = ranked._inverted(list(range(300)), counts).to_pylist()[0]
    n_terms = sum(c.total() for c in counts)
    paired = [(t, int(w)) for t, w in zip(terms, rng.integers(1, 3000, 12), strict=True)]
    plain = ranked.Block(row, 300, n_terms)
    scores = np.zeros((12, 300), np.int64)
    for k, (t, w) in enumerate(paired):
        docs, impacts = plain.postings(plain.place[t])
        scores[k, docs] = w * impacts
    first, second = np.triu_indices(12, 1)
    joint = [int(np.where((scores[i] > 0) & (scores[j] > 0), scores[i] + scores[j], 0).max()) for i, j in zip(first, second, strict=True)]
    block = ranked.Block(row | {"maxima": np.maximum.reduceat(plain.impacts(), plain.starts[:-1]).tolist(), "joint": joint}, 300, n_terms)
    order = np.argsort(scores.max(axis=1), kind="stable")
    maxima = scores.max(axis=1)[order]
    bounds = ranked.prefix_bounds(maxima, order, ranked.pair_savings(block, paired))
    assert (bounds[1:] >= np.cumsum(scores[order], axis=0).max(axis=1)).all()
    assert (bounds[1:] <= np.cumsum(maxima)).all() and bounds[-1] < maxima.sum()
    searcher = ranked.Searcher([paired], paired, 3)
    for _ in range(2):  # the second time the threshold is known
        searcher.see(block)
    total = scores.sum(axis=0)
    assert list(searcher.best[0][0]) == sorted(np.repeat(total, 2).tolist(), reverse=True)[:3]
