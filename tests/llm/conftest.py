import os

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that the operators use for themselves.
    *(T.StructField(n, T.StringType()) for n in ("key", "digest", "_row", "shard", "block", "place", "kept", "score", "label", "sig", "_id")),
])


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    words = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    texts = [
        (1, "one two three four five six seven eight nine ten eleven twelve"), (2, None), (3, ""), (4, " \n\t "),
        (5, "one two three four five six seven eight nine ten eleven twelve"),
        (5, "one two three four five six seven eight nine ten eleven twelve"),
        (6, words), (7, words + " tail"), (None, "no id here but words enough to pass the rules of length"), (None, None),
        (8, "short"), (9, "a\nb\na\nb\na\nb"), (10, "été 中文 \U0001F600 <|endoftext|> it's password = \"abcdefghijkl123456\""),
        (11, "x" * 300_000), (12, "x\x1cy\x00z \x85 q"), (2**62, "one  two three four five six seven eight nine ten eleven twelve"),
    ]
    out = []
    for i, (doc, text) in enumerate(texts):
        out.append(Row(doc, text, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None, *[None if i % 2 else "v"] * 11))
    return out


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (3, None, None), (5, 1, 1), (5, 0, 1), (None, 1, 1), (77, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(os.path.join(data, "documents.parquet"))


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}
