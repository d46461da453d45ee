"""Operator 10: secrets found through a trigram inverted index.

Each rule is a regular expression. From its parse tree follow sets of trigrams one of which any match must contain whole (a Boolean query: or of
ands). The index has a posting (trigram, document) for every trigram that a rule asks for and a lower-cased text contains; postings
that meet in all trigrams of a set make the document a candidate of the rule, and only candidates are searched with the expression. Rules
without mandatory trigrams search every text.

Base rules: ``assign`` (its value has 6 characters or more), ``access``, ``hex``; matches are leftmost and do not overlap within a kind. The further rules
add spans and touch no base span. Places are code points, the end exclusive.

Everything is DataFrame expressions; postings move (trigram, id), and texts move once, to their candidates' rules.

Defined results: null text: empty, no spans; rows that repeat an id with the same text get the same spans; an empty table gives no rows.
"""

from __future__ import annotations


from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.llm.common import documents, id_of, text_of

#: Kind, expression (in the common subset of Java's and Python's syntax), group that must have ``least`` characters, least.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    ("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    ("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("maps_key", r"AIza[0-9A-Za-z_-]{35}", 0, 1),
    ("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20:@/]{1,100}:[^\x00-\x20:@/]{1,100}@", 0, 1),
)
RULES = BASE + MORE

#: Exact strings a part of an expression may stand for before it counts as unknown.
EXACT = 16
#: Sets of a query before the weakest form (their common trigrams) is used.
TERMS = 32

Query = frozenset  # of frozensets of trigrams: one set must be contained whole; the empty set asks for nothing
ANY: Query = frozenset({frozenset()})


def _grams(text: str) -> frozenset:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _and(a: Query, b: Query) -> Query:
    out = frozenset(x | y for x in a for y in b)
    if len(out) > TERMS:
        out = frozenset({frozenset.intersection(*out)})
    return frozenset(x for x in out if not any(y < x for y in out))


def _or(queries: list[Query]) -> Query:
    out = frozenset().union(*queries)
    out = frozenset(x for x in out if not any(y < x for y in out))
    return out if len(out) <= TERMS else frozenset({frozenset.intersection(*out)})


def _exact_query(strings: set[str]) -> Query:
    return _or([frozenset({_grams(s)}) for s in strings])


def _walk(tree) -> tuple[set[str] | None, Query]:
    """(all strings the tree can match, if few; the query of its trigrams), in lower case."""
    exact: set[str] | None = {""}
    query, run = ANY, exact
    for op, arg in tree:
        if op is sre.LITERAL:
            part, own = {chr(arg).lower()}, ANY
        elif op is sre.IN and (chars := _class(arg)) is not None:
            part, own = chars, ANY
        elif op is sre.SUBPATTERN:
            part, own = _walk(arg[-1])
        elif op is sre.BRANCH:
            found = [_walk(x) for x in arg[1]]
            own = _or([_and(q, _exact_query(e) if e is not None else ANY) for e, q in found])
            part = set().union(*(e for e, _ in found)) if all(e is not None for e, _ in found) else None
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            e, q = _walk(inner)
            own = q if low else ANY
            part = e | {""} if (low, high) == (0, 1) and e is not None else e if (low, high) == (1, 1) else None
            if part is None and low and e is not None:
                own = _and(own, _exact_query(e))
        else:
            part, own = None, ANY
        query = _and(query, own)
        joined = {a + b for a in run for b in part} if part is not None else None
        if joined is not None and len(joined) <= EXACT:
            run = joined
            exact = joined if exact is not None else None
        else:  # what was exact so far ends here; the next run starts anew
            query = _and(query, _exact_query(run))
            run, exact = (part if part is not None and len(part) <= EXACT else {""}), None
    if exact is None:
        query = _and(query, _exact_query(run))
    return exact, query


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < EXACT:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= EXACT else None


def trigram_query(pattern: str) -> Query:
    """Sets of lower-case trigrams: a text that matches contains all of at least one set."""
    exact, query = _walk(parser.parse(pattern))
    return _and(query, _exact_query(exact)) if exact is not None else query


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def postings(texts: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, __id, __crc) for each of the trigrams that a text contains; of columns __id, __crc, __text."""
    low = F.transform(F.array(lower_ascii(F.col("__text"))), lambda t: F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(t, g)))
    return texts.select("__id", "__crc", F.explode(F.get(low, 0)).alias("gram"))


def candidates(texts: DataFrame, rules=RULES) -> DataFrame:
    """(__id, __crc, __rules): bit r is set if rule r's query holds; documents without any are absent."""
    asked: dict[str, list[tuple[int, int, int]]] = {}
    sizes: dict[int, tuple[int, int]] = {}
    for r, rule in enumerate(rules):
        query = trigram_query(rule[1])
        if frozenset() in query:
            continue
        for term in sorted(query, key=sorted):
            number = len(sizes)
            sizes[number] = (r, (1 << len(term)) - 1)
            for bit, gram in enumerate(sorted(term)):
                asked.setdefault(gram, []).append((r, number, bit))
    if not asked:
        return texts.select("__id", "__crc", F.lit(0).cast("bigint").alias("__rules")).limit(0)
    grams = sorted(asked)
    spark = texts.sparkSession
    entries = [(g, n, 1 << b, r, sizes[n][1]) for g in grams for r, n, b in asked[g]]
    wanted = spark.createDataFrame(entries, "gram string, term int, bit bigint, rule int, whole bigint")  # a row per trigram of a rule
    met = postings(texts, grams).join(F.broadcast(wanted), "gram").groupBy("__id", "__crc", "term", "rule", "whole").agg(F.bit_or("bit").alias("has"))
    met = met.where("has = whole")
    return met.groupBy("__id", "__crc").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("__rules"))


def spans_of(text: Column, number: int, rule: tuple) -> Column:
    """(start, number, end) of a rule's matches in a text: the lengths between and of matches, added up."""
    _, pattern, group, least = rule
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    between = F.split(text, pattern, -1)
    rows = F.zip_with(hits, F.slice(between, F.lit(1), F.size(hits)), lambda h, b: F.struct(F.char_length(h).alias("h"), F.char_length(b).alias("b")))
    rows = F.zip_with(rows, values, lambda r, v: F.struct(r["h"].alias("h"), r["b"].alias("b"), F.char_length(v).alias("v")))
    kind = "struct<start:bigint,kind:int,end:bigint>"
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(acc, r):
        start = acc["at"] + r["b"]
        end = start + r["h"]
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(r["v"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, zero, step, lambda acc: acc["out"])


def scan(docs: DataFrame, more=MORE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; one row per document."""
    rules = BASE + tuple(more)
    text = text_of(docs)
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), id_of(docs).alias("__id"), F.crc32(text.cast("binary")).alias("__crc"), text.alias("__text"))
    found = candidates(rows.select("__id", "__crc", "__text"), rules)
    rows = rows.join(found, ["__id", "__crc"], "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    parts = []
    for r, rule in enumerate(rules):
        own = spans_of(F.col("__text"), r, rule)
        indexed = frozenset() not in trigram_query(rule[1])
        parts.append(F.when(F.coalesce(F.col("__rules"), F.lit(0)).bitwiseAND(F.lit(1 << r)) != 0, own).otherwise(none) if indexed else own)
    rows = rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("__spans"))
    names = F.array(*[F.lit(r[0]) for r in rules])
    write = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("__spans", lambda x: x["kind"] == k)).cast("bigint")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(write(F.filter("__spans", lambda x: x["kind"] < len(BASE))), 256).alias("base_sha256"), write(F.col("__spans")).alias("spans"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
