import duckdb
import pytest
from pyspark.sql import types as T

BASE = "/root/testdata/sf0.001"

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       # names that operators use for columns of their own
                       T.StructField("score", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("k", T.StringType()), T.StructField("_n", T.StringType())])

LONG = " ".join(f"w{i % 997}" for i in range(40_000))
PASSAGE = " ".join(f"common{i}" for i in range(60))


def _row(i, text, source="a"):
    return (i, text, "en", source, None if text is None else len(text), "x", 1, "y", "z")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, one very long text, ties, repeated rows."""
    rows = [_row(1, "alpha beta gamma delta epsilon zeta"), _row(1, "alpha beta gamma delta epsilon zeta"), _row(2, None), _row(3, ""), _row(4, " \t\n "), _row(5, LONG), _row(6, LONG),
            _row(None, "a text without a number", None), (None,) * 9, _row(7, "é ü x \U0001F600 token = 'abcd1234efgh'", None), _row(8, PASSAGE + "\nown line eight"), _row(9, "line nine\n" + PASSAGE), _row(10, "one")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from read_parquet('{BASE}/{t}.parquet')")
    return c
