"""Operator 8: SimHash near-duplicates with pivot distance tables.

A fingerprint has a bit set where over half of the shingle hashes (XXH64, seed 42) have it. The Hamming distances of every fingerprint
to 32 fixed reference fingerprints are computed once. By the triangle inequality two fingerprints within radius r differ by at most r in each
of these numbers, so a candidate pair with a larger difference anywhere is discarded; survivors are verified bit by bit.

Candidate pairs come from equal bits. Up to radius 2 the 64 bits are four quarters: two of them are equal in any linked pair, so the six
pairs of quarters miss no link. Near-duplicates by likeness take a second fingerprint (the hashes mixed once more), and seeded sets of the
128 bits are drawn, as many as reach ``recall`` at the likeness asked for; their number of bits grows with the logarithm of the table.

Texts with equal fingerprints are one node. Buckets of at most ``COLD`` fingerprints are joined in pairs. A larger bucket is never
paired up: up to radius 2, all its fingerprints one bit flip away from a common value are linked to the smallest of them (two fingerprints within
2 bits always share such a value, and those that share one are within 2), so no link is lost; in the search by likeness the bucket is split
by further bits, in three ways, and its members are compared with the centre of their parts. That search first compares every member of a bucket with its
centre alone (the first in one of ``CENTRES`` seeded orders, so that a member meets several), and then only pairs that are not yet in one group: in a small bucket all of them, in a larger one those of the members outside its commonest
group with all others (if that are more than ``COLD``, in blocks): a large group of near copies costs a few comparisons each, and none of its
members is left out because it differs from the centre. Those pairs must also agree in a sketch of ``SKETCH`` bits, one from each of as many
least hashes of the set of shingles, which tells likeness 0.8 from 0.6 where 128 bits do not.

Scale of that search: rows cross an exchange once per set of bits in either part, and sizes, centres and pairs of a bucket are found where its
rows meet; only the members of large buckets and what is close to a centre are stored.

Defined results: null text: empty; no words: fingerprint zero, linked like any other; repeated rows share their component; an empty table gives
no rows; a null id counts as the smallest.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slotledger.llm.common import documents, id_of, packed, stored, text_of

WORDS = 3
RADIUS = 2
HASH_SEED = 42
COLD = 64
N_PIVOTS = 32


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def pivots(n: int = N_PIVOTS, seed: int = 1) -> list[int]:
    draw = random.Random(seed)
    return [_signed(draw.getrandbits(64)) for _ in range(n)]


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set where over half of the hashes have it."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def hashes_of(text: str, words: int = WORDS) -> np.ndarray:
    """A hash per shingle, repeats included; none for a text without words."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split()  # both touch ASCII alone
    digest = xxhash.xxh64_intdigest
    runs = (b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1) if w else 0))
    return np.fromiter((digest(r, HASH_SEED) for r in runs), dtype=np.uint64)


def fingerprint(text: str, words: int = WORDS) -> int:
    return majority(hashes_of(text, words))


def second(hashes: np.ndarray) -> int:
    """Another fingerprint, from the same hashes mixed once more."""
    x = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return majority((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))


#: Bits of the sketch of a set of shingles.
SKETCH = 512
_FACTORS = np.random.default_rng(3).integers(0, 2**31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def sketch(hashes: np.ndarray) -> list[int]:
    """A bit of the least hash by each of ``SKETCH`` orders of the set (signed, 64 to a number); repeats do not count."""
    least = np.full(SKETCH, 2**32 - 1, dtype=np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1024):
        least = np.minimum(least, (x[at : at + 1024, None] * _FACTORS).min(axis=0))
    return np.packbits((least >> np.uint32(8)).astype(np.uint8) & 1).view(np.int64).tolist()


def sketch_apart(likeness: float) -> int:
    """Most bits in which the sketches of two sets of that Jaccard likeness differ, but for a chance below 1e-4: each does with chance (1 - likeness) / 2."""
    p = (1 - likeness) / 2
    return math.ceil(SKETCH * p + 4.2 * math.sqrt(SKETCH * p * (1 - p)))


def fingerprints(docs: DataFrame, words: int = WORDS, twice: bool = False) -> DataFrame:
    """doc_id, __id, __crc, fp and, if ``twice``, fp2 (signed) and the sketch."""
    names = ["doc_id", "__id", "__crc", "fp", *["fp2", "sketch"] * twice]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [hashes_of(t.as_py(), words) for t in b.column(3)]
            fps = [pa.array([_signed(f(h)) for h in every], pa.int64()) for f in (majority, second)[: 1 + twice]]
            fps += [pa.array([sketch(h) for h in every], pa.list_(pa.int64()))] * twice
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *fps], names=names)

    text = text_of(docs)
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), id_of(docs).alias("__id"), F.crc32(text.cast("binary")).alias("__crc"), text.alias("__text"))
    schema = ", ".join(f"{n} {'array<bigint>' if n == 'sketch' else 'bigint'}" for n in names)
    return stored(rows.mapInArrow(make, schema), "fingerprints")


def quarter_masks() -> list[int]:
    quarters = [((1 << 16) - 1) << (16 * i) for i in range(4)]
    return [a | b for a, b in itertools.combinations(quarters, 2)]


def drawn_masks(n: int, likeness: float, recall: float, seed: int = 7) -> list[tuple[int, int]]:
    """Sets of bits of two fingerprints that a pair of Jaccard ``likeness`` shares at least once with chance ``recall``."""
    bits = max(12, math.ceil(math.log2(max(n, 2))) - 2)
    agree = 1 - math.acos(2 * likeness / (1 + likeness)) / math.pi
    count = math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))
    draw = random.Random(seed)
    masks = [sum(1 << b for b in draw.sample(range(128), bits)) for _ in range(count)]
    return [(m & (2**64 - 1), m >> 64) for m in masks]


def pivot_table(fps: DataFrame, n: int = N_PIVOTS) -> DataFrame:
    """Distinct fingerprints (of one fp the smallest fp2) with their distances to the references, eight to a number (d0, d1, ...)."""
    out = fps.groupBy("fp").agg(F.min("fp2").alias("fp2")) if "fp2" in fps.columns else fps.select("fp").distinct()
    return with_distances(out, n)


def with_distances(out: DataFrame, n: int) -> DataFrame:
    refs = pivots(n)
    for k in range(0, n, 8):
        packed_ = F.lit(0).cast("bigint")
        for i, p in enumerate(refs[k : k + 8]):
            packed_ = packed_.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("bigint"), 8 * i))
        out = out.withColumn(f"d{k // 8}", packed_)
    return out


def near_in_table(radius: int, n: int) -> Column:
    """No coordinate differs by more than the radius (a. and b. are rows of the pivot table)."""
    cond = F.lit(True)
    for k in range(n):
        side = lambda s: F.shiftrightunsigned(F.col(f"{s}.d{k // 8}"), 8 * (k % 8)).bitwiseAND(F.lit(255))  # noqa: B023, E731
        cond = cond & (F.abs(side("a") - side("b")) <= radius)
    return cond


def apart(name: str, a: str = "a.", b: str = "b.") -> Column:
    return F.bit_count(F.col(a + name).bitwiseXOR(F.col(b + name)))


def buckets(table: DataFrame, keys: list[Column], cold: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the table once per key they share with others (c: number of the key), in cold and in hot buckets."""
    names = table.columns
    every = F.array(*[F.struct(F.lit(i).alias("c"), k.alias("key")) for i, k in enumerate(keys)])
    keyed = table.select(*names, F.explode(every).alias("k")).select(*names, "k.c", "k.key")
    sizes = keyed.groupBy("c", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = stored(keyed.join(sizes, ["c", "key"]), "buckets")
    return keyed.where(f"n <= {cold}"), keyed.where(f"n > {cold}")


def paired(cold: DataFrame, radius: int, n_pivots: int, verified: Column) -> DataFrame:
    """(a, b), a < b, of rows in one bucket: by the pivot table, then verified."""
    same = (F.col("a.c") == F.col("b.c")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    pairs = cold.alias("a").join(cold.alias("b"), same & near_in_table(radius, n_pivots) & verified)
    return pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def links(table: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """(a, b), a < b: links of a radius up to 2; in hot buckets not all of them, but as many as connect the same groups."""
    cold, hot = buckets(table, [F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks], COLD)
    pairs = paired(cold, radius, N_PIVOTS, apart("fp") <= radius)
    flips = F.array(*[F.lit(0).cast("bigint"), *[F.lit(_signed(1 << i)) for i in range(64)]])
    near = hot.select("fp").distinct().select("fp", F.explode(flips).alias("f")).select("fp", F.col("fp").bitwiseXOR(F.col("f")).alias("z"))
    met = near.groupBy("z").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a <> top").select("z", "a")
    star = near.join(met, "z").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(star).distinct()


#: Search by likeness: bits that may differ in the first fingerprint and in both; references of its pivot table.
WIDE, WIDE_BOTH, WIDE_PIVOTS = 22, 34, 8
#: Chance puts about four fingerprints into a bucket; one with more than this many holds near copies and is split, in so many ways.
WIDE_COLD, SPLITS = 16, 3
#: Orders in which a bucket's centre is the first of its members: a member far from one centre is close to another.
CENTRES = 8


def _verified(a: str = "a.", b: str = "b.") -> Column:
    return (apart("fp", a, b) <= WIDE) & (apart("fp", a, b) + apart("fp2", a, b) <= WIDE_BOTH)


def _in_buckets(table: DataFrame, masks: list[tuple[int, int]], **more: Column) -> DataFrame:
    """Rows of the table once per set of bits (c) they share with others, with their number n and ``more`` over the bucket.

    The distances do not cross the exchange. A bucket meets in one task, which keeps its rows on disk if they are many.
    """
    both = lambda m: F.xxhash64(F.col("fp").bitwiseAND(F.lit(_signed(m[0]))), F.col("fp2").bitwiseAND(F.lit(_signed(m[1]))))
    names = [c for c in table.columns if c != "d0"]
    every = F.array(*[F.struct(F.lit(i).alias("c"), both(m).alias("key")) for i, m in enumerate(masks)])
    keyed = table.select(*names, F.explode(every).alias("k")).select(*names, "k.c", "k.key")
    keyed = keyed.repartition("c", "key")  # here, so that what the windows take is made behind the exchange
    of = W.partitionBy("c", "key")
    return keyed.select("*", F.count(F.lit(1)).over(of).alias("n"), *[v.over(of).alias(k) for k, v in more.items()]).where("n > 1")


def wide_buckets(table: DataFrame, masks: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """(a, b) of each member of a cold bucket that is close to its centre, and the rows of hot buckets."""
    rows = _in_buckets(table, masks, low=F.min(F.struct(F.xxhash64("fp", F.col("c") % CENTRES).alias("by"), "fp", "fp2")))
    close = (F.col("low.fp") != F.col("fp")) & _verified("low.", "")
    rows = rows.where((F.col("n") > WIDE_COLD) | close).select("fp", "fp2", "c", "key", "n", F.col("low.fp").alias("a"))
    rows = stored(rows, "buckets")
    cold = rows.where(F.col("n") <= WIDE_COLD).select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b"))
    return cold, with_distances(rows.where(F.col("n") > WIDE_COLD).drop("a"), WIDE_PIVOTS)


def wide_stars(cold: DataFrame, hot: DataFrame, n_masks: int) -> DataFrame:
    """(a, b): each member of a bucket (of a hot one: of a part of it) with its centre; a row per member at most."""
    draw = random.Random(11)
    names = ["fp", "fp2", "d0", "c", "key"]
    more = [F.array(*[F.lit(_signed(sum(1 << b for b in draw.sample(range(64), 8)))) for _ in range(n_masks)]) for _ in range(SPLITS)]
    part = hot.select(*names, F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.get(m, F.col("c")))) for i, m in enumerate(more)])).alias("z"))
    centre = F.min(F.struct(F.xxhash64("fp", F.col("c") % CENTRES).alias("by"), "fp", "fp2", "d0"))
    least = part.groupBy("c", "key", "z").agg(centre.alias("low")).select("c", "key", "z", "low.fp", "low.fp2", "low.d0")
    star = part.alias("b").join(least.alias("a"), ["c", "key", "z"]).where(F.col("a.fp") != F.col("b.fp"))
    star = star.where(near_in_table(WIDE, WIDE_PIVOTS) & _verified())
    return cold.union(star.select(F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b"))).distinct()


def wide_pairs(table: DataFrame, masks: list[tuple[int, int]], roots: DataFrame) -> DataFrame:
    """(a, b): pairs of cold buckets that ``roots`` does not connect yet."""
    named = table.select("fp", "fp2").join(roots, F.col("fp") == F.col("node"), "left")
    named = stored(named.select("fp", "fp2", F.coalesce("root", "fp").alias("root")), "rooted")
    cold = with_distances(_in_buckets(named, masks).where(F.col("n") <= WIDE_COLD), WIDE_PIVOTS)
    return paired(cold, WIDE, WIDE_PIVOTS, _verified() & (F.col("a.root") != F.col("b.root"))).distinct()


def _first_met(masks: list[tuple[int, int]]) -> Column:
    """No set of bits before their bucket's (a.c) is one the rows a. and b. share, too."""
    sets = F.array(*[F.struct(F.lit(_signed(m[0])).alias("x"), F.lit(_signed(m[1])).alias("y")) for m in masks])
    differ = lambda name, m: F.col(f"a.{name}").bitwiseXOR(F.col(f"b.{name}")).bitwiseAND(m) != 0
    return F.forall(F.slice(sets, F.lit(1), F.col("a.c")), lambda m: differ("fp", m["x"]) | differ("fp2", m["y"]))


def wide_rest(
    hot: DataFrame, roots: DataFrame, masks: list[tuple[int, int]] | None = None, sketches: DataFrame | None = None, likeness: float = 0.8
) -> DataFrame:
    """(a, b): pairs of hot buckets that ``roots`` does not connect yet and whose ``sketches`` (fp, sketch), where given, are close.

    The members outside a bucket's commonest group meet all members of other groups. They are dealt into blocks of about ``COLD``, and the
    bucket's members are repeated for each block, so no pair is left out and no task holds all pairs of a bucket. With ``masks`` a pair
    counts in the first bucket it shares only; where that is a cold one, ``wide_pairs`` has it.
    """
    named = hot.join(roots, F.col("fp") == F.col("node"), "left")
    parts = named.select("fp", "fp2", "d0", F.coalesce("root", "fp").alias("root"), "c", "key")
    groups = parts.groupBy("c", "key", "root").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.groupBy("c", "key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
    groups = groups.select("c", "key", F.col("top.root").alias("main"), F.ceil((F.col("n") - F.col("top.n")) / COLD).cast("int").alias("blocks"))
    parts = parts.join(groups.where("blocks > 0"), ["c", "key"])
    parts = stored(parts if sketches is None else parts.join(sketches, "fp"), "parts")
    outside = parts.where("root <> main").withColumn("block", F.pmod(F.xxhash64(F.lit(17), "fp"), F.col("blocks")).cast("int"))
    every = parts.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    apart_yet = F.col("a.root") != F.col("b.root")
    for name in ("c", "key", "block"):
        apart_yet = apart_yet & (F.col(f"a.{name}") == F.col(f"b.{name}"))
    once = (F.col("b.root") == F.col("b.main")) | (F.col("a.fp") < F.col("b.fp"))
    close = near_in_table(WIDE, WIDE_PIVOTS) & _verified()
    if sketches is not None:
        close = close & sketches_near(sketch_apart(likeness))
    if masks is not None:
        close = close & _first_met(masks)
    met = outside.alias("a").join(every.alias("b"), apart_yet & once & close)
    return met.select(F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b")).distinct()


def sketches_near(most: int) -> Column:
    """At most so many bits of two sketches differ (a. and b.)."""
    differ = F.lit(0)
    for k in range(SKETCH // 64):
        differ = differ + F.bit_count(F.get("a.sketch", F.lit(k)).bitwiseXOR(F.get("b.sketch", F.lit(k))))
    return differ <= most


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node with an edge.

    Alternating large and small stars; both halves of a round are written to the shared folder, and the driver sees a checksum, observed
    as the second is written. Edges that are stars already take one round.
    """

    def summed(pairs: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        mixed = F.xxhash64("u", "v")
        sums = [F.count(F.lit(1)).alias("n"), F.bit_xor(mixed).alias("x"), F.sum(mixed.bitwiseAND(F.lit(2**31 - 1))).alias("s")]
        rows = stored(pairs.observe(seen, *sums), "stars")
        return rows, tuple(seen.get[k] for k in ("n", "x", "s"))

    down = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    down, last = summed(down)
    while True:
        both = down.union(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        down, state = summed(small.where("u <> v").distinct())
        if state == last:
            break
        last = state
    return down.select(F.col("u").alias("node"), F.col("v").alias("root")).union(down.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def linked(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, __id, __crc, fp, component_id of each document."""
    fps = fingerprints(docs, words)
    if radius > 2:
        raise ValueError("exact links need a radius of 2 or less; near_duplicates() takes more")
    roots = components(links(pivot_table(fps), quarter_masks(), radius))
    return with_least(fps, roots)


def with_least(fps: DataFrame, roots: DataFrame) -> DataFrame:
    least = fps.groupBy("fp").agg(F.min("__id").alias("low"))
    least = least.join(roots, least["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    of_root = least.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stored(least.join(of_root, "root").select("fp", "component_id"), "named")
    return fps.join(named, "fp")


def near_duplicates(docs: DataFrame, words: int = 5, likeness: float = 0.8, recall: float = 0.99) -> DataFrame:
    """doc_id, __id, __crc, component_id: groups linked by SimHash candidates whose shingle sets have that Jaccard likeness."""
    fps = fingerprints(docs, words, twice=True)
    table = stored(pivot_table(fps, WIDE_PIVOTS), "table")
    masks = drawn_masks(table.count(), likeness, recall)
    stars, hot = wide_buckets(table, masks)
    first = F.min(F.struct("__id", "__crc", "sketch")).alias("r")
    reps = stored(fps.groupBy("fp").agg(first).select("fp", "r.__id", "r.__crc", "r.sketch"), "reps")
    ids, sketches = reps.drop("sketch"), reps.select("fp", "sketch")
    # stars first: they connect large groups with a link or two per document; of all other pairs only those between groups are left
    first = stored(alike(docs, ids, stored(wide_stars(stars, hot, len(masks)), "candidates"), words, likeness), "links")
    roots = components(first)
    found = wide_pairs(table, masks, roots).union(wide_rest(hot, roots, masks, sketches, likeness)).distinct()
    rest = alike(docs, ids, stored(found, "candidates"), words, likeness)
    # the first links' groups are stars already: they connect what those links connect
    return with_least(fps, components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(rest)))


def alike(docs: DataFrame, reps: DataFrame, found: DataFrame, words: int, likeness: float) -> DataFrame:
    """The candidates (a, b) whose texts' shingle sets have the Jaccard likeness."""
    asked = found.select(F.col("a").alias("fp")).union(found.select(F.col("b").alias("fp"))).distinct()
    keyed = docs.select(id_of(docs).alias("__id"), text_of(docs).alias("__text")).withColumn("__crc", F.crc32(F.col("__text").cast("binary")))
    texts = keyed.join(reps.join(asked, "fp").hint("merge"), ["__id", "__crc"]).select("fp", "__text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [shingle_set(t.as_py(), words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["fp", "s"])

    sets_of = stored(texts.mapInArrow(sets, "fp bigint, s array<bigint>").dropDuplicates(["fp"]), "shingles")
    both = found.join(sets_of.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a").join(sets_of.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= likeness * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def shingle_set(text: str, words: int) -> list[int]:
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split()
    runs = {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    return [_signed(xxhash.xxh64_intdigest(r, HASH_SEED)) for r in runs]


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents, one of each group: the one with the smallest id (of equal ids the smallest checksum)."""
    groups = near_duplicates(docs, **options)
    keep = groups.groupBy("component_id").agg(F.min(F.struct("__id", "__crc")).alias("r")).select("r.__id", "r.__crc")
    return packed(docs).join(keep.hint("merge"), ["__id", "__crc"]).dropDuplicates(["__id", "__crc"]).select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
