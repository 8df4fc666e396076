import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """Documents with nulls, blanks, ties, repeated rows, a long text and clashing extra columns."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, "a b c", "en", "s1"), (2, "a  b\nc ", "en", "s1"), (3, None, "en", None), (4, "", None, "s2"),
            (5, " \t\n", "de", "s2"), (5, " \t\n", "de", "s2"), (None, "a b c", "en", "s1"), (7, long, "en", "s2"),
            (8, long + "!", "en", "s2"), (9, "one two three four five six seven eight nine ten eleven", "en", "s1"),
            (10, "Released under the MIT License.", "en", "s1")]
    return spark.createDataFrame([(*r, 0, "x", 1.0) for r in rows],
                                 "doc_id long, text string, lang string, source string, size int, row string, score double")


@pytest.fixture
def empty(docs):
    return docs.where("false")
