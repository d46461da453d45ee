"""Operators 3, 4, 5 and 10 against plain Python over whole texts."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from slotledger.llm import fingerprints, licenses, line_dedup, secrets

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def signed(x):
    return x - 2**64 if x >= 2**63 else x


# --- line dedup ---------------------------------------------------------------------------------------------------


def brute_cuts(rows, min_words):
    """Lines to cut by the rules of the operator, from every pair (first holder, later holder)."""
    docs = {}
    for doc_id, text, *_ in rows:
        key = (-(2**63) if doc_id is None else doc_id, __import__("zlib").crc32((text or "").encode()))
        docs[key] = [(x.strip(" \t\n\x0b\x0c\r"), len(SPLIT.findall(x))) for x in (text or "").split("\n")]
    first = {}
    for key in sorted(docs):
        for x, n in docs[key]:
            if n:
                first.setdefault(x, key)
    out = {}
    for key, lines in docs.items():
        aligned = set()
        names = {}
        number = lambda x: names.setdefault(x[0], len(names) + 1) if x[1] else 0  # noqa: B023, E731
        for early in {first[x] for x, n in lines if n} - {key}:
            aligned |= set(line_dedup._patience([number(x) for x in docs[early]], [number(x) for x in lines]))
        shared = sum(n for x, n in lines if n and first[x] != key)
        if shared >= min_words:
            out[key] = line_dedup._runs(aligned, [number(x) for x in lines], [n for _, n in lines], min_words)
    return {k: v for k, v in out.items() if v}


def check_lines(got, rows, min_words):
    cuts = brute_cuts(rows, min_words)
    want = Counter()
    for doc_id, text, *_ in rows:
        key = (-(2**63) if doc_id is None else doc_id, __import__("zlib").crc32((text or "").encode()))
        cut = set(cuts.get(key, ()))
        new = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in cut) if cut else text
        want[doc_id, new, len(cut)] += 1
    assert Counter((r.doc_id, r.text, r.n_cut) for r in got) == want


def passages():
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefgh", k=5))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(30) for _ in range(6)]
    common = "All rights reserved here"
    rows = []
    for i in range(60):
        own = [line(12) for _ in range(4)] + [common]
        at = draw.randrange(5)
        if i % 3 == 0:
            own[at:at] = shared[:3]
        elif i % 3 == 1:
            own[at:at] = ["", shared[3], " ", shared[4] + " ", shared[draw.randrange(3)]]
        rows.append((i, "\n".join(own), "en", "s"))
    return rows + [(100 + i, rows[i][1], "en", "s") for i in range(20)]


def test_lines_equal_plain_python(frame, small, odd):
    for rows, least in ((passages(), 50), (small + [(None if r[0] is None else r[0] + 10_000, *r[1:]) for r in odd], 20)):
        check_lines(line_dedup.dedup_lines(frame(rows, clash=True), least).collect(), rows, least)


def test_repeated_passages_go_and_short_common_lines_stay(frame):
    rows = passages()
    docs = frame(rows)
    out = {r.doc_id: r.text for r in line_dedup.cut_passages(docs).collect()}
    assert out[0] == rows[0][1] and all(out[100 + i] == "" for i in range(1, 20))
    later = [i for i in range(3, 60, 3)]
    shared = set(rows[0][1].split("\n")) & set(rows[3][1].split("\n")) - {"All rights reserved here"}
    for i in later:  # the passage goes, lines of one's own stay
        assert {x for x in rows[i][1].split("\n") if x not in shared} - {"All rights reserved here"} <= set(out[i].split("\n"))
        assert not shared & set(out[i].split("\n"))
    assert all(out[i] == rows[i][1] for i in range(2, 60, 3))
    assert line_dedup.cut_passages(docs).columns == docs.columns
    assert line_dedup.cut_passages(frame([])).count() == 0


@pytest.mark.parametrize("cut", [line_dedup.dedup_lines, line_dedup.cut_passages])
def test_cuts_meet_texts_by_one_plan_at_every_size(frame, cut):
    """The cuts grow with the input: while they were few they were broadcast, later every text crossed an exchange."""
    plan = cut(frame([(i, "some line of text") for i in range(9)]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [__id" in plan and "BroadcastHashJoin" not in plan


def test_patience_keeps_the_order_of_lines():
    a, b = [1, 2, 3, 4, 5, 6], [4, 9, 1, 2, 7, 3, 6]
    assert sorted(line_dedup._patience(a, b)) == [2, 3, 5, 6]
    draw = random.Random(1)
    for _ in range(300):
        a, b = ([draw.randrange(1, 9) for _ in range(draw.randrange(12))] for _ in range(2))
        got = sorted(line_dedup._patience(a, b))
        assert len(set(got)) == len(got)
        it = iter(a)
        assert all(b[j] in it for j in got)  # a common subsequence


def cut_words(text):
    return {w for x in (text or "").split("\n") for w in x.split()}


def made_lines(seed):
    draw = random.Random(seed)
    return lambda n: " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(n))


def test_a_passage_that_is_twice_in_both_holders_goes_at_each_place(frame):
    line = made_lines(11)
    passage = [line(20) for _ in range(3)]
    text = lambda *parts: "\n".join(x for p in parts for x in p)
    rows = [(1, text([line(9)], passage, [line(9)], passage, [line(9)])), (2, text([line(9)], passage, [line(9)], passage, [line(9)])),
            (3, text([line(9)], passage, [line(9)])), (4, text([line(9), line(9)], passage[:1], passage[1:], passage))]
    out = {r.doc_id: (r.text, r.n_cut) for r in line_dedup.dedup_lines(frame(rows)).collect()}
    assert out[1] == (rows[0][1], 0)
    assert [out[i][1] for i in (2, 3, 4)] == [6, 3, 6]
    assert not any(cut_words("\n".join(passage)) & cut_words(out[i][0]) for i in (2, 3, 4))


def test_passages_in_another_order_and_of_a_later_holder_go(frame):
    line = made_lines(12)
    p, q = ([line(20) for _ in range(3)] for _ in range(2))
    own = lambda: [line(9)]
    scattered = [x for y in (p[2], p[0], p[1]) for x in (y, line(9))]
    halves = lambda: own() + p[:2] + own() + p[2:] + own()
    text = lambda *parts: "\n".join(x for y in parts for x in y)
    for rows, cut in (
        ([text(p, q), text(own(), q, p, own())], [0, 6]),
        ([text(p, own(), q), text(own(), q), text(q, own(), p)], [0, 3, 6]),
        ([text(scattered), text(own(), p), text(own(), p, own())], [0, 0, 3]),
        ([text(scattered), halves(), text(own(), p, own())], None),
    ):
        rows = [x if isinstance(x, str) else text(x) for x in rows]
        got = {r.doc_id: r.n_cut for r in line_dedup.dedup_lines(frame(list(enumerate(rows)))).collect()}
        assert [got[i] for i in range(len(rows))] == (cut or [0, 0, 3])


def test_a_range_without_unique_lines_is_aligned():
    assert sorted(line_dedup._patience([9, 1, 2, 3, 8, 1, 2, 3, 7], [5, 1, 2, 3, 6, 1, 2, 3, 4])) == [1, 2, 3, 5, 6, 7]


def test_windows_cover_exactly_the_runs_of_common_lines_with_enough_words():
    draw = random.Random(3)
    for _ in range(300):
        n = draw.randrange(14)
        hashes = [draw.randrange(0, 9) for _ in range(n)]
        words = [draw.randrange(1, 30) if h else 0 for h in hashes]
        common = set(range(1, draw.randrange(2, 10)))
        got = line_dedup._windows(hashes, words, common, 50)
        covered = {i for _, lo, hi in got for i in range(lo, hi + 1) if hashes[i]}
        assert covered == {i for i in line_dedup._runs({i for i, h in enumerate(hashes) if h in common}, hashes, words, 50) if hashes[i]}
        assert all(sum(words[lo : hi + 1]) >= 50 for _, lo, hi in got)


# --- sketches -----------------------------------------------------------------------------------------------------


def brute_sketch(text):
    words = SPLIT.findall(text)
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    out = set()
    for i in range(max(1, len(h) - 4) if h else 0):
        seed = 42
        for x in h[i : i + 5]:
            seed = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)
        out.add(signed(seed))
    return sorted({x for x in out if x < fingerprints.LIMIT} | ({min(out)} if out else set()))


def brute_likeness(a, b):
    return 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))


def test_fingerprints_equal_plain_python(frame, small, odd):
    rows = small + [(None if r[0] is None else r[0] + 10_000, *r[1:]) for r in odd]
    got = Counter(tuple(r) for r in fingerprints.fingerprints(frame(rows, clash=True)).collect())
    rows = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], (r[1] or "").encode()))
    want = Counter()
    write = lambda s: "".join(f"{x % 2**64:016x}" for x in s)
    for i, r in enumerate(rows):
        text, after = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        a, e, n = brute_sketch(text), brute_sketch(edited), brute_sketch(after)
        want[r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), write(a), write(e), brute_likeness(a, e), brute_likeness(a, n), len(a)] += 1
    assert got == want


def test_successors_across_ranges_of_ids(frame, monkeypatch):
    from slotledger.llm import common

    monkeypatch.setattr(common, "BUCKET_ROWS", 3)
    draw = random.Random(2)
    ids = sorted(draw.sample(range(-500, 10**6), 40) + [10**12])
    got = fingerprints.with_next(frame([(i, f"t{i}") for i in ids]).select("doc_id", "text"), "text").collect()
    assert {r.doc_id: r.__next_text if hasattr(r, "__next_text") else r[-1] for r in got} == {i: f"t{j}" for i, j in zip(ids, ids[1:] + ids[:1], strict=True)}
    assert fingerprints.fingerprints(frame([])).count() == 0


def test_containment_between_unequal_texts_and_merging(spark, frame):
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(6000)]
    whole, part, other = " ".join(words), " ".join(words[1000:2000]), " ".join(reversed(words[:1000]))
    df = spark.createDataFrame([(whole, part, other)], "w string, p string, o string").select(*[fingerprints.sketch(F.col(c)).alias(c) for c in "wpo"])
    r = df.select(fingerprints.containment(F.col("p"), F.col("w")), fingerprints.containment(F.col("o"), F.col("w")), fingerprints.containment(F.col("w"), F.col("p")), F.size(fingerprints.merge(F.col("p"), F.col("o"))), F.size("p") + F.size("o")).first()
    assert r[0] == 1.0 and r[1] < 0.05 and abs(r[2] - 1 / 6) < 0.05 and r[3] == r[4]


# --- licences -----------------------------------------------------------------------------------------------------


def grams(text):
    w = re.findall("[a-z0-9]+", text.lower())
    return {(a, b) for a, b in zip(w, w[1:], strict=False)}


def brute_license(text):
    text = text or ""
    units = {*text.split("\n"), *re.split(r"\n\s*\n", text), text}
    hits = []
    matched = set()
    for u in units:
        g = grams(u)
        for name, t in licenses.TEMPLATES:
            h = grams(t)
            if g and (d := 2 * len(g & h) / (len(g) + len(h))) >= licenses.THRESHOLD:
                hits.append((-d, name))
                matched.add(u)
    best = min(hits, default=(None, None))
    return best[1], None if best[0] is None else round(-best[0], 6), ",".join(sorted({n for _, n in hits})), len(matched)


def test_licenses_equal_plain_python(frame, small, odd):
    notices = [t for _, t in licenses.TEMPLATES]
    more = [(20_000 + i, f"Some text before.\n{t.upper()}\nand after") for i, t in enumerate(notices)]
    more += [(21_000 + i, " ".join(t.split()[: max(2, len(t.split()) * 9 // 10)]) + "\n\nother") for i, t in enumerate(notices)]
    rows = small + [(None if r[0] is None else r[0] + 10_000, *r[1:]) for r in odd] + more
    got = Counter(tuple(r) for r in licenses.scan(frame(rows, clash=True)).collect())
    assert got == Counter((r[0], *brute_license(r[1])) for r in rows)
    assert sum(v for k, v in got.items() if k[1]) >= len(notices)
    assert licenses.scan(frame([])).count() == 0


# --- secrets ------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(text):
    text = text or ""
    out = []
    out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    base = sorted(out)
    for k, rule in enumerate(secrets.MORE, 3):
        out += [(m.start(), k, m.end()) for m in re.finditer(rule[1], text)]
    write = lambda spans: ",".join(f"{secrets.RULES[k][0]}:{s}:{e}" for s, k, e in sorted(spans))
    return sum(k == 0 for _, k, _ in base), sum(k == 1 for _, k, _ in base), sum(k == 2 for _, k, _ in base), hashlib.sha256(write(base).encode()).hexdigest(), write(out)


PARTS = [
    "token", "Password", "PASSWD", "secret", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "abc", "abcdef", "x/y+z.w", "AKIA", "ABCDEFGHIJ0123456789",
    "0123456789abcdef", "deadbeef", "\U0001f600", "é", "\n", "ghp_" + "a1" * 20, "xoxb-1234567890ab", "eyJhbGciOi", ".", "eyJzdWIiOiI", "AIza" + "b" * 35,
    "https://", "user", "@host", "-----BEGIN RSA PRIVATE KEY-----", "ſecret", "toKen",
]


def test_secrets_equal_plain_python(frame, small, odd):
    draw = random.Random(9)
    made = [(30_000 + i, "".join(draw.choices(PARTS, k=draw.randrange(1, 14)))) for i in range(1500)]
    rows = small + [(None if r[0] is None else r[0] + 10_000, *r[1:]) for r in odd] + made
    got = Counter(tuple(r) for r in secrets.scan(frame(rows, clash=True)).collect())
    assert got == Counter((r[0], *brute_spans(r[1])) for r in rows)
    assert secrets.scan(frame([])).count() == 0


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r[0])
def test_every_match_holds_a_set_of_its_query(rule):
    query = secrets.trigram_query(rule[1])
    assert (rule[0] == "hex") == (frozenset() in query)
    draw = random.Random(6)
    pattern = re.compile(rule[1], re.A)
    for _ in range(4000):
        text = "".join(draw.choices(PARTS, k=8))
        for m in pattern.finditer(text):
            low = m[0].lower()
            assert any(all(g in low for g in s) for s in query)


def test_queries_of_plain_expressions():
    assert secrets.trigram_query("abcd") == frozenset({frozenset({"abc", "bcd"})})
    assert secrets.trigram_query("(abc|xyz)+") == frozenset({frozenset({"abc"}), frozenset({"xyz"})})
    assert secrets.trigram_query("ab?c") == secrets.ANY
    assert secrets.trigram_query("a[bc]d") == frozenset({frozenset({"abd"}), frozenset({"acd"})})
