"""Streams over tables of one file or many."""

import re
from datetime import datetime
from pathlib import Path

import pytest

from intakeloom.plans import queries_classify as classify
from intakeloom.plans import queries_sources as sources
from intakeloom.plans.registry import QUERIES
from intakeloom.plans.views import view

ROWS = [(k, f"Dear desk, case {k} is open, please help. " * 3, "en", "web", 120) for k in range(24)]
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def in_files(spark, tmp_path):
    """The documents in a folder of six files."""
    docs = spark.createDataFrame(ROWS, COLUMNS)
    docs.repartition(6, "doc_id").write.option("maxRecordsPerFile", 4).parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["s14_stream_intake", "s14_streamed_then_changed"])
def test_a_table_in_many_files_is_streamed_whole(spark, in_files, name):
    wanted = {f"web-{k}.txt" for k in range(24) if name == "s14_stream_intake" or k % 7}
    assert {row.source for row in QUERIES[name](spark, in_files).collect()} == wanted


def test_batches_are_as_many_as_deliveries_however_many_files(spark, in_files, monkeypatch):
    started = []

    def recorded(*args, **kwargs):
        started.append(record(*args, **kwargs))
        return started[-1]

    record = sources.record_stream
    monkeypatch.setattr(sources, "record_stream", recorded)
    assert QUERIES["s14_delivered_twice"](spark, in_files).count() == 24
    read = [[p["numInputRows"] for p in run.recentProgress if p["numInputRows"]] for run in started]
    # the second run meets all 24 again, then the first run met 24 and the 8 that came again
    assert [sum(rows) for rows in read] == [32, 24] and [len(rows) for rows in read] == [2, 1]


def test_late_replies_share_the_mails_and_join_once_a_batch(spark, tmp_path, monkeypatch):
    rows = [(k, k % 5, "FOP"[k % 3], f"{1 + k % 5}-HIGH", 1000.0 + k, datetime(2024, 1, 1)) for k in range(40)]
    columns = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string, o_totalprice double, o_orderdate timestamp"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    people = spark.createDataFrame([(k, f"Customer#{k}") for k in range(5)], "c_custkey bigint, c_name string")
    people.write.parquet(f"{tmp_path}/customer.parquet")
    started, files = [], []

    def recorded(docs, at, ledger_path, *args, **kwargs):
        files.extend(Path(re.sub("^file:", "", ledger_path)).parent.glob("mails/*.parquet"))
        return record(docs, at, ledger_path, *args, **kwargs)

    def replied(*args, **kwargs):
        started.append(reply(*args, **kwargs))
        return started[-1]

    record, reply = classify.record_stream, classify.reply_stream
    monkeypatch.setattr(classify, "record_stream", recorded)
    monkeypatch.setattr(classify, "reply_stream", replied)
    versions = [row.version for row in QUERIES["c09_late_replies"](spark, str(tmp_path)).collect()]
    answered = view(spark, str(tmp_path), "replies").where("response IS NOT NULL")
    assert len(versions) == 40 and versions.count(2) == answered.count()
    assert len(files) > 1  # all tasks extract
    first = started[0].recentProgress[0]
    join = next(s for s in first["stateOperators"] if s["operatorName"] == "symmetricHashJoin")
    assert join["numRowsTotal"] == 40 + answered.where("doc_id % 2 = 0").count()


def test_late_replies_extract_once_and_hold_state_in_files(spark, tmp_path, monkeypatch):
    from intakeloom.plans import intake as plan
    from intakeloom.streaming import intake as streams

    rows = [(k, k % 2, "FOP"[k % 3], f"{1 + k % 5}-HIGH", 1000.0 + k, datetime(2024, 1, 1)) for k in range(12)]
    columns = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string, o_totalprice double, o_orderdate timestamp"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/orders.parquet")
    people = spark.createDataFrame([(k, f"Customer#{k}") for k in range(2)], "c_custkey bigint, c_name string")
    people.write.parquet(f"{tmp_path}/customer.parquet")
    extracted, started = [], []

    def counted(*args, **kwargs):
        extracted.append(kwargs)
        return facts(*args, **kwargs)

    def replied(*args, **kwargs):
        started.append(reply(*args, **kwargs))
        return started[-1]

    facts, reply = plan.intake_facts, classify.reply_stream
    monkeypatch.setattr(plan, "intake_facts", counted)
    monkeypatch.setattr(streams, "intake_facts", counted)
    monkeypatch.setattr(classify, "reply_stream", replied)
    before = {name: spark.conf.get(name, None) for name in streams.STATE_SETTINGS}
    found = QUERIES["c09_late_replies"](spark, str(tmp_path)).collect()
    wanted = {row.doc_id for row in view(spark, str(tmp_path), "replies").where("response IS NOT NULL").collect()}
    assert len(found) == 12 and {int(re.sub(r"\D", "", row.source)) for row in found if row.version == 2} == wanted
    assert len(extracted) == 1  # by the stream that records
    states = started[0].recentProgress[0]["stateOperators"]
    assert states and all(any(name.startswith("rocksdb") for name in s["customMetrics"]) for s in states)
    assert {name: spark.conf.get(name, None) for name in streams.STATE_SETTINGS} == before
