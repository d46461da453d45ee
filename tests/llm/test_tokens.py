"""Operators 2 and 9: ids, order and places of token sequences."""

import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from slotledger.llm import packing, packing_plan, tokens, training_order

RARE = "  　﻿​\u0085 ́ßİıſ\U0001f600漢字ñ٣Ⅷ²'’ \t\n\r\x0b\x0c\x00\x1cab12.,!_-"


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_those_of_the_other_library(reference, small, odd):
    draw = random.Random(3)
    texts = [r[1] for r in small] + [r[1] for r in odd] + ["".join(draw.choices(RARE, k=draw.randrange(40))) for _ in range(2000)]
    path = tokens.vocabulary()
    assert all(tokens.ids_of(t, path).tolist() == reference(t) for t in texts)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 1000, 4096, 70_001])
def test_permutation_is_a_bijection(n):
    got = training_order.permute(np.arange(n), n)
    assert sorted(got.tolist()) == list(range(n))
    assert n < 100 or (got != np.arange(n)).mean() > 0.9
    assert n < 1000 or (got != training_order.permute(np.arange(n), n, key=1)).mean() > 0.9


def expected_pieces(reference, rows, size):
    out = Counter()
    for doc_id, text, *_ in rows:
        ids = [*reference(text), 2]
        for p in range(0, len(ids), size):
            out[doc_id, p // size, tuple(ids[p : p + size])] += 1
    return out


def test_training_order_round_trip(spark, frame, small, odd, reference, tmp_path):
    rows = small[:60] + odd
    records = training_order.training_order(frame(rows, clash=True), shard_sequences=100).cache()
    got = records.orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(len(got)))
    ids = lambda r: tuple(np.frombuffer(r.record[4 : 4 + 2 * r.length], "<u2").tolist())
    assert Counter((r.doc_id, r.piece, ids(r)) for r in got) == expected_pieces(reference, rows, training_order.STRIDE)
    assert all(r.shard == r.slot // 100 and r.byte_offset == r.slot % 100 * 516 and len(r.record) == 516 for r in got)
    assert all(r.ids_crc32 == zlib.crc32(np.array(ids(r), "<u4").tobytes()) for r in got)
    files = training_order.write_shards(records, f"file://{tmp_path}/shards").orderBy("first_slot").collect()
    assert sum(f.n for f in files) == len(got) and all(f.bytes == f.n * 516 for f in files)
    for f in files:
        start = f.first_slot + f.n // 2  # resume in the middle
        back = training_order.read_slots(f.asDict() | {"file": f"file://{f.file}"}, start, f.first_slot + f.n - start)
        assert [tuple(x.tolist()) for x in back] == [ids(r) for r in got[start : f.first_slot + f.n]]


def test_the_query_writes_shards_and_reads_its_digests_from_them(spark, sf, reference):
    from slotledger.llm import common

    before = set(Path(common.shared_dir(spark).removeprefix("file:")).glob("shards-*"))
    got = sorted(training_order.query(spark, sf).collect(), key=lambda r: r.slot)
    (folder,) = set(Path(common.shared_dir(spark).removeprefix("file:")).glob("shards-*")) - before
    shards = defaultdict(bytes)
    for f in sorted(folder.iterdir()):
        shards[int(f.name.split("-")[1])] += f.read_bytes()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == sum(-(-(len(reference(t)) + 1) // 256) for t in docs.values()) == sum(map(len, shards.values())) / 516
    for r in got:
        record = shards[r.shard][r.byte_offset : r.byte_offset + 516]
        n = int.from_bytes(record[:4], "little")
        ids = np.frombuffer(record[4 : 4 + 2 * n], "<u2")
        assert n == r.length and zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32 and not any(record[4 + 2 * n :])
        assert ids.tolist() == [*reference(docs[r.doc_id]), 2][r.piece * 256 :][:256]


def test_packed_ids_are_whole_and_smaller():
    """All 16-bit ids, one id, none, and ids with common ones: fewer bytes than raw ids compressed as they are."""
    rng = np.random.default_rng(1)
    common = (rng.zipf(1.3, 100_000) % 4_000 * 13 + 5).astype("<u2")
    for ids in (common, rng.permutation(65536).astype("<u2"), np.array([7], "<u2"), np.array([], "<u2")):
        assert training_order.unpacked_ids(training_order.packed_ids(ids)).tolist() == ids.tolist()
    assert len(training_order.packed_ids(common)) < 0.85 * len(pa.compress(common.tobytes(), "zstd", asbytes=True))


def test_stored_and_shuffled_ids_are_packed(frame, small, reference, monkeypatch):
    """Many runs and many deals give the records of few; the stored table holds its sequences in packed runs."""
    whole = sorted(map(repr, training_order.training_order(frame(small)).drop("slot", "byte_offset", "shard").collect()))
    monkeypatch.setattr(training_order, "RUN_IDS", 700)
    monkeypatch.setattr(training_order, "DEALT_IDS", 2_000)
    assert sorted(map(repr, training_order.training_order(frame(small)).drop("slot", "byte_offset", "shard").collect())) == whole
    runs = training_order.encoded(frame(small)).collect()
    assert len(runs) > 10 and sum(r["__n"] for r in runs) == len(whole)
    ids = [i for r in sorted(runs, key=lambda r: (r["__block"], r["__first"])) for i in training_order._opened(bytes(r["rows"]))[1].tolist()]
    assert Counter(ids) == Counter(i for _, text, *_ in small for i in [*reference(text), 2])


def test_written_records_are_those_of_the_files(spark, frame, small, tmp_path):
    records = training_order.training_order(frame(small), shard_sequences=100)
    rows = training_order.written(records, f"file://{tmp_path}/shards")
    assert rows.orderBy("slot").collect() == records.drop("record").orderBy("slot").collect()
    at = sorted((tmp_path / "shards").iterdir())[0]
    at.write_bytes(b"\1\0\0\0" + b"\7" * 512 + at.read_bytes()[516:])
    changed = rows.orderBy("slot").first()
    assert changed.length == 1 and changed.ids_crc32 == zlib.crc32(np.array([0x0707], "<u4").tobytes())


def test_training_order_of_an_empty_table(frame):
    assert training_order.training_order(frame([])).count() == 0


def check_packed(got, rows, reference, size=packing.SIZE):
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = [*reference(text), 2]
        at, n = 0, len(ids) % size or size
        p = 0
        while at < len(ids):
            want[doc_id, p, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at, n, p = at + n, size, p + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences), -(-sum(r.length for r in got) // size)


def test_packing_places_every_piece_once(frame, small, odd, reference):
    rows = small + odd
    n, least = check_packed(packing.pack(frame(rows, clash=True)).collect(), rows, reference)
    assert n <= least * 1.02 + 1
    assert packing.pack(frame([])).count() == 0


def test_one_length_may_hold_all_pieces(frame, reference, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 50)  # several buckets of one length
    rows = [(i, "The same text", "en", "s") for i in range(700)]
    n, least = check_packed(packing.pack(frame(rows)).collect(), rows, reference)
    assert n == least


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece_and_is_near_the_bound(seed):
    draw = np.random.default_rng(seed)
    size = 256
    hist = np.bincount(np.clip(draw.lognormal(4, 0.8, 40_000).astype(int), 1, size - 1), minlength=size + 1)
    got = packing_plan.plan(hist, size)
    back = np.zeros(size + 1, dtype=int)
    for kind, n in got:
        assert sum(kind) <= size
        for x in kind:
            back[x] += n
    assert (back == hist).all()
    bound = max(-(-(hist * np.arange(size + 1)).sum() // size), hist[size // 2 + 1 :].sum())
    assert sum(n for _, n in got) <= bound * 1.005 + 2
    assert packing_plan.plan(np.zeros(size + 1), size) == []
