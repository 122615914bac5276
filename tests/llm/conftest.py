import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

FOLDER = "/root/testdata/sf0.001"

#: Texts of every kind that an operator may meet.
ODD_TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "Two words",
    "two WORDS",
    "same text, twice over, with a few more words in it than the others have, said again",
    "same text, twice over, with a few more words in it than the others have, said again",
    "é日本語 ½ 　x\x00y <|endoftext|> 'tis don't 're 've'll\n\n  end  ",
    "z" * 5000,
    "line\nline\nline\r\nline\r\n",
    "word " * 4000,
    "a b c d e f g h " * 300,
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts beside columns whose names operators use inside."""
    rows = [(i, text, "x", i, "k", "b", 1.5) for i, text in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, key string, size bigint, kept string, label string, score double"
    )


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


@pytest.fixture(scope="session")
def documents(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return {row.doc_id: row.text for row in rows}
