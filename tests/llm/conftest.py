import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

TEXTS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, tag string, row string"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from ``(doc_id, text)`` or ``(doc_id, text, source)``, with extra columns whose
    names clash with those of the results."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, "x", "y", "z", "w") for r in rows]
        return spark.createDataFrame(full, TEXTS).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest test table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

