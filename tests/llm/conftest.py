import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)

#: Column names that operators use themselves or return.
CLASHES = ("__id", "__crc", "size", "slot", "shard", "fp", "h", "key", "n", "kept", "copies", "length", "domain", "n_tokens", "cut", "x0")


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text[, lang, source]) rows."""

    def make(rows, parts=3, clash=False):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "src1")), len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(parts)
        if clash:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit(7).alias(c) for c in CLASHES])
        return df

    return make


@pytest.fixture(scope="session")
def small(spark, sf):
    """(doc_id, text, lang, source) of the smallest documents table, by id."""
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("doc_id", "text", "lang", "source").collect()]


LONG = "word other. " * 30_000
ODD = [
    (None, "null id, some words to read here", "en", "src1"),
    (1, None, "en", "src1"),
    (2, "", "en", "src2"),
    (3, " \t\n\x0b\x0c\r ", None, "src2"),
    (4, "one", "en", None),
    (5, "Ünïcode wörds and \U0001f600 faces\nnext line", "de", "plain"),
    (6, LONG, "en", "src1"),
    (7, "a repeated row of text", "en", "src1"),
    (7, "a repeated row of text", "en", "src1"),
    (8, "a repeated row of text", "en", "src1"),
    (9, "<|endoftext|> is text", "fr", "src10"),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
