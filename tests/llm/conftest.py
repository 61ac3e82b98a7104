import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

import pytest  # noqa: E402
from pyspark.sql.types import LongType, StringType, StructField, StructType  # noqa: E402

DOCUMENT = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                       StructField("source", StringType()), StructField("n_chars", LongType()), StructField("score", StringType())])


@pytest.fixture(scope="session")
def llm_spark(spark):
    from flowwatch.llm.workspace import ship_code
    ship_code(spark)
    return spark


#: Nulls in any column, empty and blank texts, repeated rows, ties, a long text; ``score`` clashes with operators' columns.
ODD = [
    (1, None, None, None, None, "x"), (2, "", "en", "a", 0, None), (3, " \n\t ", "en", "a", 3, "x"),
    (4, "one two three four five six\nseven " * 30, "en", "b", 1, "x"), (4, "one two three four five six\nseven " * 30, "en", "b", 1, "x"),
    (5, "one two three four five six\nseven " * 30, "de", None, 1, "x"), (None, "no id here at all, only words of text", None, "b", 1, "x"),
    (6, "1234 ... !!! 5678", "fr", "c", 1, "x"), (7, "wordy " * 20000, "fr", "c", 1, "x"), (8, "x" * 30000, "es", "c", 1, "x"),
    (9, "café żółć 日本語 😀 \x00 ▁ <|endoftext|> <s>", "es", "c", 1, "x"),
]


@pytest.fixture(scope="session")
def odd(llm_spark):
    return llm_spark.createDataFrame(ODD, DOCUMENT)


@pytest.fixture(scope="session")
def empty(llm_spark):
    return llm_spark.createDataFrame([], DOCUMENT)
