"""Small tables with everything that is odd in one place."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from brute import TEXTS  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, sig string, key string, size int"
@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, repeats, ties, empty and long texts, and columns operators use inside."""
    rows = [
        (doc, text, None if k % 3 else "en", source, None if text is None else len(text), k, None, "k", None)
        for k, (doc, text, source) in enumerate(TEXTS)
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    schema = "doc_id bigint, quality int, toxic int"
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, None, None), (None, 0, 1), (99, 0, 1)], schema)
