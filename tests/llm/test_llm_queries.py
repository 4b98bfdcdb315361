"""The registered queries on the given tables: against SQL, plain versions or held-out labels."""

import sys
from pathlib import Path

import pytest
import tiktoken
from brute import personal, secrets, sha, written_out

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import check

from intakeloom.llm import bpe, syncmers
from intakeloom.llm.queries import ORACLES, QUERIES, vocabulary

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    return {row.doc_id: row.text or "" for row in rows}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, name):
    with check.connect(SMALL) as connection:
        assert check.compare(spark, connection, SMALL, name) is None


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_syncmers(spark, texts):
    ids = sorted(texts)
    for row in QUERIES["op4_syncmers"](spark, SMALL).collect():
        text, after = texts[row.doc_id], texts[ids[(ids.index(row.doc_id) + 1) % len(ids)]]
        moved = len(text) // 4
        changed = text[: len(text) - moved] + after[:moved]
        prints = [syncmers.print_of(x) for x in (text, changed, after)]
        assert (row.n_chars, row.edited_sha256) == (len(text), sha(changed))
        assert row.fingerprint == syncmers.written_out(prints[0])
        assert row.edited_fingerprint == syncmers.written_out(prints[1])
        assert row.near_edited == syncmers.likeness(prints[0], prints[1])
        assert row.near_next == syncmers.likeness(prints[0], prints[2])


def test_bpe(spark, texts):
    path, pattern = vocabulary()
    public = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for row in QUERIES["op5_bpe"](spark, SMALL).collect():
        ids = public.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == sha(",".join(map(str, ids)))
        assert row.decoded_sha256 == sha(texts[row.doc_id])


def test_personal(spark, texts):
    for row in QUERIES["op9_personal"](spark, SMALL).collect():
        base = personal(texts[row.doc_id])
        assert row.base_sha256 == sha(written_out(base))
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [
            sum(kind == wanted for kind, _, _ in base) for wanted in ("email", "ip", "card", "phone")
        ]


def test_secrets(spark, texts):
    for row in QUERIES["op10_secrets"](spark, SMALL).collect():
        base = secrets(texts[row.doc_id])
        assert row.base_sha256 == sha(written_out(base))
        assert [row.n_assign, row.n_access, row.n_hex] == [
            sum(kind == wanted for kind, _, _ in base) for wanted in ("assign", "access", "hex")
        ]


@pytest.mark.parametrize("name, label, least", [("op7_quality", "quality", 0.95), ("op8_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    labels = {row.doc_id: row[label] for row in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = [row for row in QUERIES[name](spark, MIDDLE).collect()]
    outside = [row for row in rows if row.held_out and row.doc_id in labels]
    assert len(rows) == 1000 and len(outside) > 50
    assert sum(row.predicted == labels[row.doc_id] for row in outside) >= least * len(outside)
