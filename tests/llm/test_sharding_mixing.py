"""Operators 1 and 7: orders and budgets against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from slotledger.llm import mixing, sharding


def brute_shards(rows, shards):
    by = defaultdict(list)
    for doc_id, text, _, source in rows:
        data = (text or "").encode()
        crc = zlib.crc32(data)
        key_id = -(2**63) if doc_id is None else doc_id
        by[source].append((hashlib.md5(f"{sharding.SEED}:{key_id}:{crc}".encode()).hexdigest(), doc_id, len(data) + 8, crc))
    order = []
    for source, docs in by.items():
        docs.sort(key=lambda d: d[0])
        order += [(Fraction(2 * i + 1, 2 * len(docs)), source is not None, source or "", d) for i, d in enumerate(docs)]
    order.sort(key=lambda x: (x[0], x[1], x[2], x[3][0]))
    out, seen = [], Counter()
    for place, (_, _, _, d) in enumerate(order):
        shard = place * shards // len(order)
        out.append((d[1], d[2], d[3], shard, seen[shard]))
        seen[shard] += 1
    return Counter(out)


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_shards_equal_plain_python(frame, small, odd, shards):
    rows = small + [(None if r[0] is None else r[0] + 10_000, *r[1:]) for r in odd]
    got = sharding.interleaved_shards(frame(rows, clash=True), shards=shards).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == brute_shards(rows, shards)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_every_shard_matches_the_mixture(frame):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 else f"s{i % 9}") for i in range(3000)]
    got = sharding.interleaved_shards(frame(rows), shards=10).collect()
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    per = Counter((r.shard, r.source) for r in got)
    for source, n in Counter(r[3] for r in rows).items():
        assert all(abs(per[s, source] - n / 10) <= 2 for s in range(10))


def test_shards_of_an_empty_table(frame):
    assert sharding.interleaved_shards(frame([])).count() == 0


def brute_mix(rows, total=None, alpha=mixing.ALPHA, epochs=mixing.MAX_EPOCHS):
    def domain(source):
        m = re.search(r"([0-9]{1,9})$", source or "")
        return mixing.DOMAINS[int(m[1]) // 5 % 4] if m else "other"

    docs = [(d, t or "", domain(s), lang, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, lang, s in rows]
    tokens = Counter()
    for d in docs:
        tokens[d[2:5]] += d[5]

    def fill(budget, nodes):
        given, open_ = {}, dict(nodes)  # name: (cap, weight)
        while open_:
            weight = sum(w for _, w in open_.values())
            level = budget / weight if weight else 0.0
            full = {k: c for k, (c, w) in open_.items() if w > 0 and c <= level * w}
            if not full:
                return given | {k: level * w for k, (_, w) in open_.items()}
            k = min(full, key=lambda k: (open_[k][0] / open_[k][1], k or ""))
            given[k] = full[k]
            budget -= full[k]
            del open_[k]
        return given

    def down(budget, depth, prefix):
        names = {k[depth] for k in tokens if k[:depth] == prefix}
        part = {n: sum(v for k, v in tokens.items() if k[: depth + 1] == (*prefix, n)) for n in names}
        given = fill(budget, {n: (v * epochs, v**alpha if v else 0.0) for n, v in part.items()})
        if depth == 2:
            return {(*prefix, n): given[n] for n in names}
        return {k: v for n in names for k, v in down(given[n], depth + 1, (*prefix, n)).items()}

    budgets = {k: int(v + 1e-6) for k, v in down(float(sum(tokens.values()) if total is None else total), 0, ()).items()}
    out = []
    for leaf, budget in budgets.items():
        full, rest = divmod(budget, tokens[leaf]) if tokens[leaf] else (0, 0)
        own = [d for d in docs if d[2:5] == leaf]
        own.sort(key=lambda d: hashlib.md5(f"{mixing.SEED}:{full}:{-(2**63) if d[0] is None else d[0]}:{zlib.crc32(d[1].encode())}".encode()).hexdigest())
        for d in own:
            rest -= d[5]
            out.append((d[0], *leaf, d[5], budget, full + (rest >= 0)))
    return Counter(out)


@pytest.mark.parametrize("total", [None, 2000.0, 0.0, 1e12])
def test_mixing_equals_plain_python(frame, small, odd, total):
    rows = small[:150] + [(None if r[0] is None else r[0] + 10_000, *r[1:]) for r in odd]
    got = mixing.mix(frame(rows, clash=True), total=total).drop("__id", "__crc").collect()
    assert Counter(map(tuple, got)) == brute_mix(rows, total)


def test_shortage_goes_to_siblings_before_ancestors(spark, frame):
    rows = [(i, "w " * 10, "en", "src1") for i in range(10)] + [(100 + i, "w " * 10, "en", "src2") for i in range(100)]
    rows += [(1000 + i, "w " * 10, "en", "src7") for i in range(100)]
    weights = spark.createDataFrame([("web", "en", "src1", 2.0), ("web", "en", "src2", 1.0), ("books", "en", "src7", 3.0)], "domain string, lang string, source string, weight double")
    got = mixing.mix(frame(rows), total=1200.0, max_epochs=1, weights=weights)
    leaf = {r.source: r.leaf_budget for r in got.select("source", "leaf_budget").distinct().collect()}
    assert leaf == {"src1": 100, "src2": 500, "src7": 600}  # web's half stays in web although src1 is short


def test_mixing_materialises_copies_with_the_columns_of_documents(frame, small):
    docs = frame(small[:120], clash=True)
    want = mixing.mix(docs)
    out = mixing.materialise(docs)
    assert out.columns == docs.columns
    assert out.count() == want.agg({"copies": "sum"}).first()[0]
    assert mixing.materialise(frame([])).count() == 0
