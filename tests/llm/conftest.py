import os

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use as well."""
    base = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree by the river bank"
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    rows = [
        (1, base, "s1"), (2, base + " ", "s1"), (3, base.replace("river", "water"), "s1"), (4, base, None),
        (4, base, None), (5, None, "s1"), (6, "", "s2"), (7, " \n\t ", "s2"), (None, base, "s2"), (None, None, None),
        (8, "one two", "s1"), (9, "One  two", "s1"), (10, long, "s3"), (11, long + " end", "s3"), (12, "é ü 日本 　 x", "s2"),
        (13, base.upper(), "s4"), (-5, "one two", "s4"),
    ]
    schema = T._parse_datatype_string("doc_id long, text string, source string, hash string, row string, n long, token string, rank int")
    return spark.createDataFrame([(*r, "h", "r", 1, "t", 0) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
