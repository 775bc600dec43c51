import os

import duckdb
import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "benchmark", "labels", "pages")

PROSE = (
    "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall oak tree and nobody in the "
    "village knows why they came or when they will leave again because owls never tell anybody about their plans"
)
LONG = " ".join(f"word{i}x{i % 31}" for i in range(60_000))

#: Nulls, empty and very long texts, ties and repeated rows.
EDGE_ROWS = [
    (1, PROSE, "en", "a"),
    (1, PROSE, "en", "a"),
    (2, PROSE, None, None),
    (None, "no id here, but quite a few words of its own that nobody else has written so far, and so on", "en", "a"),
    (None, None, None, None),
    (3, None, "en", "a"),
    (4, "", "en", "b"),
    (5, " \n\t ", "en", "b"),
    (6, "word", "en", "b"),
    (7, LONG, "en", "b"),
    (8, "ß İ ΑΣ 日本語のテキスト 😀 \x00 end", "de", "b"),
    (9, "!!! ??? ...", "en", "a"),
]


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Rows with columns whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(EDGE_ROWS, schema).coalesce(2)
    for name in ("id", "key", "row", "score", "words", "n", "size", "host", "h", "hit", "left", "root", "class_id", "length"):
        docs = docs.selectExpr("*", f"'{name}' AS {name}")
    return docs


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def reference(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    yield connection
    connection.close()
