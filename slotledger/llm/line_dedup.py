"""Operator 3: duplicate passages, by aligning pairs of documents line by line.

1. Lines become hashes. Every hash that occurs in more than one document links each later holder to the first one,
   so a line shared by thousands of documents gives thousands of links, not millions. Two adjacent lines link to the first
   document that has both so, which may be another one.
2. A document whose linked lines hold fewer than ``min_words`` words in all is left alone. For each remaining pair the lines
   that are rare enough to occur once in either document anchor a patience diff, or the longest common run where there are none;
   equal neighbours extend it.
3. The shortest runs of ``min_words`` words of shared lines, from every line on and up to every line, are keyed like lines: one that any
   earlier document holds counts as aligned wherever it stands, so passages held twice or in another order are found at each place.
4. Runs of consecutive lines of the later document that are aligned with earlier documents and hold ``min_words`` words or
   more are deleted.

Lines compare equal as written (white space at either end aside); lines without a word neither link nor break a run and go
with the run around them. Documents are ordered by id.

Defined results: a null text stays null; a text without shared passages stays as it is, byte for byte; a document that is
all passage becomes the empty text; rows that repeat an id with the same text are one document; the first holder is never cut.

Scale: texts are shuffled once (to apply the cuts, by the same plan at every size: the cuts grow with the input); links move hashes only. The common-line counts are partial aggregates;
the joins on hot lines and hot first holders are plain sort-merge joins, which runtime re-planning splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.llm.common import WORD, documents, id_of, packed, stored, text_of

MIN_WORDS = 50


def line_hashes(text: Column) -> Column:
    """(hash, words) of each line; lines without a word have hash 0 and no words."""
    raw = F.transform(
        F.split(text, "\n"),
        lambda x: F.struct(F.xxhash64(F.trim(x, F.lit("\t\n\x0b\f\r "))).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("n")),
    )
    return F.transform(raw, lambda x: F.struct(F.when(x["n"] > 0, x["h"]).otherwise(F.lit(0).cast("bigint")).alias("h"), x["n"].alias("n")))


def adjacent(hashes: str, common: str) -> Column:
    """Distinct keys of two neighbouring lines that are both in ``common``; lines without a word in between do not count."""
    h = F.filter(hashes, lambda x: x != 0)
    pairs = F.transform(h, lambda x, i: F.struct(x.alias("x"), F.get(h, i + 1).alias("y")))
    both = F.filter(pairs, lambda p: F.array_contains(common, p["x"]) & F.array_contains(common, p["y"]))
    return F.array_distinct(F.transform(both, lambda p: F.xxhash64(p["x"], p["y"])))


def _patience(a: list[int], b: list[int]) -> list[int]:
    """Indices of ``b`` that a patience diff aligns with equal lines of ``a``."""
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append(b0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append(b1)
        if a0 >= a1 or b0 >= b1:
            continue
        anchors = _increasing(_unique_common(a, a0, a1, b, b0, b1)) or _longest_run(a, a0, a1, b, b0, b1)
        if anchors:
            ends = [(a0, b0), *((i + 1, j + 1) for i, j in anchors)]
            starts = [*anchors, (a1, b1)]
            out += [j for _, j in anchors]
            todo += [(p, q, r, s) for (p, r), (q, s) in zip(ends, starts, strict=True)]
    return out


def _unique_common(a, a0, a1, b, b0, b1) -> list[tuple[int, int]]:
    """(index in a, index in b) of the lines that occur once in each range, by place in b."""

    def once(x, lo, hi):
        seen: dict[int, int] = {}
        for i in range(lo, hi):
            seen[x[i]] = -1 if x[i] in seen else i
        return seen

    left, right = once(a, a0, a1), once(b, b0, b1)
    return [(left[h], j) for h, j in right.items() if h and j >= 0 and left.get(h, -1) >= 0]


def _longest_run(a, a0, a1, b, b0, b1) -> list[tuple[int, int]]:
    """(index in a, index in b) of the longest run of consecutive equal lines: anchors where no line is there once on both sides."""
    where: dict[int, list[int]] = {}
    for i in range(a0, a1):
        if a[i]:
            where.setdefault(a[i], []).append(i)
    best, end, before = 0, (0, 0), {}
    for j in range(b0, b1):
        now = {i: before.get(i - 1, 0) + 1 for i in where.get(b[j], ())}
        for i, n in now.items():
            if n > best:
                best, end = n, (i, j)
        before = now
    return [(end[0] - k, end[1] - k) for k in range(best - 1, -1, -1)]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs that increases in both places."""
    import bisect

    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (i, _) in enumerate(pairs):
        p = bisect.bisect_left(tops, i)
        back.append(at[p - 1] if p else -1)
        if p == len(tops):
            tops.append(i)
            at.append(k)
        else:
            tops[p], at[p] = i, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _windows(hashes: list[int], words: list[int], common: set[int], min_words: int) -> list[tuple[int, int, int]]:
    """(key, first line, last line) of the shortest runs of common lines of ``min_words`` words that begin or end at each line.

    Together they cover every run of so many words: a line of it with enough words behind it begins one, a line with enough before it
    ends one, and a line with neither lies in the one that begins where the run begins.
    """
    import xxhash

    out: set[tuple[int, int, int]] = set()
    places = [i for i, h in enumerate(hashes) if h]
    data = np.array([hashes[i] for i in places], dtype="<i8").tobytes()
    total = np.concatenate([[0], np.cumsum([words[i] for i in places])])
    start = 0  # of the current stretch of common lines, as a place
    for end in range(len(places) + 1):
        if end < len(places) and hashes[places[end]] in common:
            continue
        stretch = total[start : end + 1]
        lo = np.arange(start, end)
        hi = start + np.searchsorted(stretch, stretch[:-1] + min_words)  # the run is lo..hi-1
        first = start + np.searchsorted(stretch, stretch[1:] - min_words, side="right") - 1
        both = [*zip(lo[hi <= end], hi[hi <= end], strict=True), *zip(first[first >= start], lo[first >= start] + 1, strict=True)]
        for x, y in both:
            key = xxhash.xxh64_intdigest(data[8 * x : 8 * y])
            out.add((key - 2**64 if key >= 2**63 else key, places[x], places[y - 1]))
        start = end + 1
    return sorted(out)


def _runs(aligned: set[int], hashes: list[int], words: list[int], min_words: int) -> list[int]:
    """Aligned lines in runs of enough words, with the wordless lines inside such a run."""
    out: list[int] = []
    run: list[int] = []
    total = 0

    def close():
        nonlocal run, total
        if total >= min_words:
            out.extend(range(run[0], run[-1] + 1))
        run, total = [], 0

    for i, h in enumerate(hashes):
        if i in aligned and h:
            run.append(i)
            total += words[i]
        elif h:
            close()
    close()
    return out


def cut_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(__id, __crc, __cut): the line numbers to delete, for documents that lose any."""
    lines = stored(
        docs.select(id_of(docs).alias("__id"), F.crc32(text_of(docs).cast("binary")).alias("__crc"), line_hashes(text_of(docs)).alias("__lines"))
        .select("__id", "__crc", F.col("__lines.h").alias("__h"), F.col("__lines.n").alias("__n")),
        "line-hashes",
    )
    flat = (
        lines.select("__id", "__crc", F.explode(F.arrays_zip("__h", "__n")).alias("x"))
        .select("__id", "__crc", F.col("x.__h").alias("h"), F.col("x.__n").alias("n"))
        .where("h <> 0")
    )
    # the first holder of each line; a line of one document alone has min = max
    holder = F.struct("__id", "__crc")
    shared = (
        flat.groupBy("h").agg(F.min(holder).alias("first"), F.max(holder).alias("last"))
        .where(F.col("first") != F.col("last"))
        .select("h", F.col("first.__id").alias("a_id"), F.col("first.__crc").alias("a_crc"))
    )
    other = (F.col("__id") != F.col("a_id")) | (F.col("__crc") != F.col("a_crc"))
    per_doc = flat.join(shared, "h").groupBy("__id", "__crc").agg(
        F.collect_set("h").alias("common"),
        F.collect_set(F.when(other, F.struct("a_id", "a_crc"))).alias("firsts"),
        F.sum("n").alias("all_n"),
        F.sum(F.when(other, F.col("n")).otherwise(0)).alias("n"),
    )
    per_doc = stored(per_doc.where(F.col("all_n") >= min_words).drop("all_n"), "linked")
    once = lines.dropDuplicates(["__id", "__crc"])

    def spans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [
                (i, c, *x)
                for i, c, h, n, common in zip(f["__id"], f["__crc"], f["__h"], f["__n"], f["common"], strict=True)
                for x in _windows(list(h), list(n), set(common), min_words)
            ]
            yield pd.DataFrame(rows, columns=["__id", "__crc", "key", "lo", "hi"])

    windows = per_doc.select("__id", "__crc", "common").join(once, ["__id", "__crc"]).mapInPandas(
        spans, "__id bigint, __crc bigint, key bigint, lo int, hi int"
    )
    windows = stored(windows, "windows")
    held = windows.groupBy("key").agg(F.min(holder).alias("first"), F.max(holder).alias("last")).where(F.col("first") != F.col("last"))
    held = windows.join(held.select("key", "first"), "key").where(F.struct("__id", "__crc") != F.col("first"))
    held = held.select("__id", "__crc", F.sequence("lo", "hi").alias("at"))
    # the first holder of a line may have it among others: two adjacent lines link to the first document that has them so
    later = per_doc.where(F.col("n") >= min_words)
    two = per_doc.select("__id", "__crc", "common").join(once, ["__id", "__crc"]).select("__id", "__crc", F.explode(adjacent("__h", "common")).alias("key"))
    met = two.groupBy("key").agg(F.min(holder).alias("f"), F.max(holder).alias("last")).where(F.col("f") != F.col("last")).select("key", "f")
    two = two.join(met, "key").where(F.struct("__id", "__crc") != F.col("f")).select("__id", "__crc", "f")
    two = two.join(later.select("__id", "__crc"), ["__id", "__crc"])
    asked = later.select("__id", "__crc", F.explode("firsts").alias("f")).union(two).distinct()
    asked = stored(asked.select("__id", "__crc", F.col("f.a_id").alias("a_id"), F.col("f.a_crc").alias("a_crc")), "asked")
    early = once.select(F.col("__id").alias("a_id"), F.col("__crc").alias("a_crc"), F.col("__h").alias("a_h"))
    both = asked.join(early, ["a_id", "a_crc"]).join(once.select("__id", "__crc", F.col("__h").alias("b_h")), ["__id", "__crc"])

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [sorted(_patience(list(a), list(b))) for a, b in zip(f["a_h"], f["b_h"], strict=True)]
            yield pd.DataFrame({"__id": f["__id"], "__crc": f["__crc"], "at": got})

    aligned = both.select("__id", "__crc", "a_h", "b_h").mapInPandas(align, "__id bigint, __crc bigint, at array<int>")
    united = aligned.union(held).groupBy("__id", "__crc").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))

    @F.pandas_udf("array<int>")
    def runs(at: pd.Series, h: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_runs(set(x), list(y), list(z), min_words) for x, y, z in zip(at, h, n, strict=True)], dtype=object)

    cut = united.join(once, ["__id", "__crc"]).select("__id", "__crc", runs("at", "__h", "__n").alias("__cut"))
    return stored(cut.where(F.size("__cut") > 0), "cuts")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with aligned passages deleted, plus n_lines and n_cut (lines deleted)."""
    cut = cut_lines(docs, min_words)
    joined = packed(docs).join(cut.hint("merge"), ["__id", "__crc"], "left")
    old = F.col("__row.text")
    lines = F.split(old, "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains("__cut", i))
    text = F.when(F.col("__cut").isNull(), old).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(old.isNull(), 0).otherwise(F.size(lines))
    others = [F.col("__row")[c].alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_cut")]
    n_cut = F.coalesce(F.size("__cut"), F.lit(0)).cast("bigint")
    return joined.select(*others, text.alias("text"), n_lines.cast("bigint").alias("n_lines"), n_cut.alias("n_cut"))


def cut_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their own columns; n_chars, where there is one, counts the new text where it changed."""
    cut = cut_lines(docs, min_words)
    joined = packed(docs).join(cut.hint("merge"), ["__id", "__crc"], "left")
    kept = F.filter(F.split("__row.text", "\n"), lambda x, i: ~F.array_contains("__cut", i))
    new = F.array_join(kept, "\n")
    row = F.col("__row").withField("text", new)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length(new).cast(docs.schema["n_chars"].dataType))
    return joined.select(F.when(F.col("__cut").isNull(), F.col("__row")).otherwise(row).alias("__row")).select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_cut", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
