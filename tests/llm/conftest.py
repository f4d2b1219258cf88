import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       T.StructField("key", T.StringType()), T.StructField("h", T.StringType()), T.StructField("score", T.StringType()), T.StructField("block", T.StringType()), T.StructField("label", T.StringType())])

LONG = "A line of the very long text that repeats itself over and over.\n" * 4000

#: Nulls in every column, empty and blank texts, a very long one, repeated rows and ids, ties, odd white space.
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta\nShared line of more than twenty characters", "en", "a"),
    (2, "  SHARED LINE of more than twenty characters\t\nsomething else entirely, also long enough", "en", "a"),
    (3, "shared line of more than twenty characters", "en", "b"),
    (3, "shared line of more than twenty characters", "en", "b"),
    (4, None, None, None),
    (None, "shared line of more than twenty characters\nno id here", "en", "a"),
    (None, None, "de", None),
    (5, "", "", ""),
    (6, " \t\n\x0b\x0c\r ", "en", "b"),
    (7, LONG, "en", "a"),
    (8, LONG.upper(), "en", "c"),
    (9, "éàü ßñ 你好 世界\r\nüber\x00null", "de", "c"),
    (10, "Mail john.doe@example.com or +1 (555) 010-9999 from 10.0.0.1, card 4111 1111 1111 1111.", "en", "c"),
    (10, "another text of the same id", "en", "c"),
    (11, "12345 67890 !!! ???", "fr", "a"),
    (12, "a" * 50000, "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "k", None, "s", "x", None) for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


@pytest.fixture(autouse=True, scope="package")
def few_partitions(spark):
    """The tables are tiny and the operators make many small jobs."""
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, "3")
    yield
    spark.conf.set(key, old)
