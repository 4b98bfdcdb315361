"""Every registered query against its SQL, on the smallest data."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry
import check

from intakeloom.operators import json_docs
from intakeloom.plans.catalog import ORACLES, QUERIES
from intakeloom.plans.views import view

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    with check.connect(FOLDER) as opened:
        yield opened


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees(spark, connection, name):
    assert check.compare(spark, connection, FOLDER, name) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_documents_of_every_kind_occur(spark):
    """The JSON view has all six kinds, valid and invalid, and only the cut-off kind does not parse."""
    docs = view(spark, FOLDER, "jsons")
    rows = json_docs.extract_json(docs).groupBy("detected_schema", "success", "valid").count().collect()
    seen = {(row.detected_schema, row.valid) for row in rows if row.success}
    assert {("invoice", True), ("invoice", False), ("order", True), ("product", True)} <= seen
    bad = json_docs.extract_json(docs).where("NOT success").select("doc_id").join(docs, "doc_id")
    assert {row.text[:8] for row in bad.collect()} == {'{"note":'}


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
