"""Ledger: writing, versions, queries; streams; plans."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from intakeloom.operators import admission, ledger, search_index
from intakeloom.plans.intake import ledger_rows, route_and_extract
from intakeloom.session import shared_folder
from intakeloom.sources import files
from intakeloom.streaming.intake import record_stream
from samples import INVOICE, PLAIN_MAIL

AT = "2024-05-01 00:00:00"


def at(text=AT):
    return F.lit(text).cast("timestamp")


@pytest.fixture()
def records(spark):
    rows = [
        ("1", "important_mail.txt", "EMAIL", "complaint", 1, "john@example.com", "{}", "t1", "completed", 1.5),
        ("2", "invoice.pdf", "PDF", "billing", 2, None, '{"customer": "john"}', "t1", "pending", 2.0),
        ("3", "other.txt", "EMAIL", "inquiry", 3, "eve@example.com", "{}", "t2", "completed", 0.0),
        ("4", "50%_off.txt", "EMAIL", "inquiry", 4, "", "not json", "t2", "failed", None),
    ]
    given = spark.createDataFrame(
        rows,
        "id string, source string, format string, intent string, day int, sender string, "
        "extracted_fields string, thread_id string, status string, processing_time double",
    )
    stamped = given.withColumn("timestamp", F.expr("timestamp '2024-01-01' + make_interval(0,0,0,day)"))
    return ledger.new_records(stamped.drop("day"))


def ids(frame):
    return [r.id for r in frame.collect()]


def test_defaults(records):
    row = records.filter("id = '4'").first()
    assert (row.urgency, row.processing_time, row.version, row.is_deleted) == ("normal", 0.0, 1, False)


def test_queries(records):
    assert ids(ledger.by_status(records, "completed")) == ["3", "1"]
    assert ids(ledger.by_thread(records, "t1")) == ["1", "2"]
    assert ids(ledger.all_threads(records)) == ["1", "2", "3", "4"]
    assert ids(ledger.recent(records, 2)) == ["4", "3"]
    assert ids(ledger.search(records, "JOHN")) == ["2", "1"]
    assert ids(ledger.search(records, "complaint")) == ["1"]
    assert ids(ledger.search(records, "50%\\")) == []
    assert ids(ledger.by_id(records, "2")) == ["2"]


def test_statistics(records):
    got = {(r.facet, r.value): r["count"] for r in ledger.statistics(records).collect()}
    assert got[("total", None)] == 4
    assert got[("status", "completed")] == 2
    assert got[("format", "EMAIL")] == 3
    mean = ledger.statistics(records).filter("facet = 'total'").first().avg_processing_time
    assert mean == 1.75
    none = ledger.average_time(records.filter("id = '3'")).first()[0]
    assert none == 0.0


def test_empty_ledger(spark):
    empty = spark.createDataFrame([], ledger.SCHEMA)
    row = ledger.dashboard(empty).first()
    assert (row.total_records, row.success_rate) == (0, 0.0)
    assert ledger.statistics(empty).filter("facet = 'total'").first()["count"] == 0


def test_versions(spark, records):
    changes = spark.createDataFrame([("2", "completed"), ("9", "completed")], "id string, status string")
    first = records.unionByName(ledger.update(records, changes, at()))
    again = first.unionByName(
        ledger.update(first, changes.withColumn("status", F.lit("failed")), at("2024-06-01 00:00:00"))
    )
    now = {r.id: r for r in ledger.latest(again).collect()}
    assert len(now) == 4 and (now["2"].status, now["2"].version) == ("failed", 3)
    assert now["2"].created_at < now["2"].updated_at
    gone = again.unionByName(ledger.delete(again, changes, at()))
    assert sorted(ids(ledger.latest(gone))) == ["1", "3", "4"]
    # nothing comes back to life
    assert ledger.update(gone, changes, at()).count() == 0
    assert sorted(ids(ledger.without(again, changes))) == ["1", "3", "4"]


def test_hot_record_keeps_one_latest_version(spark, records):
    """Most versions belong to one record."""
    one = records.filter("id = '1'")
    many = spark.range(1, 3001).select(F.col("id").alias("v"))
    hot = one.drop("version").crossJoin(many).withColumn("version", F.col("v")).drop("v")
    every = records.filter("id != '1'").unionByName(hot)
    now = {r.id: r.version for r in ledger.latest(every).collect()}
    assert now == {"1": 3000, "2": 1, "3": 1, "4": 1}
    moves = ledger.transitions(every)
    assert moves.filter("from_status IS NULL").count() == 4


def test_transitions(records):
    first = records.filter("id = '2'")
    begun = ledger.started(first, at())
    done = ledger.finished(begun, at(), "pdf_agent", F.lit(0.5), F.lit(0.9))
    lost = ledger.failed(done, at(), "pdf_agent", F.lit("boom"))
    kept = ledger.failed(lost, at(), "pdf_agent", F.lit(""))
    assert kept.first().error_message == "boom"
    every = first.unionByName(begun).unionByName(done).unionByName(lost)
    got = [(r.from_status, r.to_status) for r in ledger.transitions(every).orderBy("version").collect()]
    assert got == [
        (None, "pending"),
        ("pending", "processing"),
        ("processing", "completed"),
        ("completed", "failed"),
    ]


def test_sink_and_clear(spark, records):
    path = shared_folder(spark, "ledger")
    ledger.append(records, path)
    ledger.append(records.withColumn("id", F.concat(F.lit("x"), "id")), path)
    back = ledger.read(spark, path)
    assert back.count() == 8
    assert sorted(ids(back.filter("format = 'PDF'"))) == ["2", "x2"]
    ledger.clear(spark, path)
    assert ledger.read(spark, path).count() == 0


def test_codec(records):
    rows = {r.id: r for r in ledger.decode(records).select("id", F.to_json("fields").alias("f")).collect()}
    assert json.loads(rows["2"].f) == {"customer": "john"}
    assert json.loads(rows["4"].f) == {}


def test_stream_equals_batch(spark, tmp_path):
    """Files arrive in two lots; the ledger ends up as the batch plan has it."""
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.txt").write_text(PLAIN_MAIL)
    (inbox / "b.json").write_text(INVOICE)
    out, state = shared_folder(spark, "out"), shared_folder(spark, "state")

    def run():
        arriving = files.with_text(files.scan_stream(spark, str(inbox))).select(
            "doc_id", "source", "text", "file_size"
        )
        query = record_stream(arriving, at(), out, state, keep=["file_size"])
        query.awaitTermination()

    run()
    assert ledger.read(spark, out).count() == 2
    (inbox / "c.txt").write_text("short")
    run()
    batch = ledger_rows(
        route_and_extract(
            files.with_text(files.scan(spark, str(inbox))), keep=["source", "file_size"]
        ),
        at(),
    )
    columns = ["id", "source", "format", "status", "extracted_fields", "file_size"]

    def content(frame):
        return sorted(map(str, frame.select(*columns).collect()))

    assert content(ledger.read(spark, out)) == content(batch)


def test_json_lines_file_is_one_document(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":1}\n{"a":2}\n')
    assert files.whole_texts(spark, str(tmp_path)).count() == 1
    assert files.lines(spark, str(tmp_path)).count() == 2


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_intake_scans_once_and_shuffles_nothing(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [(i, f"{i}.txt", PLAIN_MAIL, "unused") for i in range(50)]
    spark.createDataFrame(rows, "doc_id int, source string, text string, extra string").write.parquet(path)
    plan = plan_of(route_and_extract(spark.read.parquet(path), keep=["source"]))
    assert plan.count("FileScan") == 1
    assert "Exchange" not in plan and "Join" not in plan
    assert "extra" not in plan.split("ReadSchema")[-1]


def test_text_is_not_shuffled_to_the_replies(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from intakeloom.operators import classify

        docs = spark.createDataFrame([(1, "a bill")], "doc_id int, text string")
        answers = spark.createDataFrame([(1, "order,0.9")], "doc_id int, response string")
        plan = plan_of(classify.classify(docs, answers).drop("content_preview"))
        exchanged = [line for line in plan.split("\n") if "Exchange" in line]
        assert exchanged and "BroadcastExchange" not in plan
        above = plan.split("Exchange")[1].split("\n")[1]
        assert "text#" not in above.split("AS")[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_format_filter_prunes_partitions(spark, records):
    path = shared_folder(spark, "pruned")
    ledger.append(records, path)
    plan = plan_of(ledger.filtered(ledger.read(spark, path), "PDF"))
    assert "PartitionFilters: [isnotnull(format" in plan


def test_search_by_index(spark, records):
    """Scan and index agree on wildcards, case, short queries, changed and deleted records."""
    path = shared_folder(spark, "indexed-test")
    odd = ledger.new_records(spark.createDataFrame(
        [("9", "İSTANBUL Ünïcode.txt", "EMAIL", "inquiry", None), ("10", "", "EMAIL", "x", "ab"), ("11", "a\\b_c.txt", "PDF", "inquiry", "")],
        "id string, source string, format string, intent string, extracted_fields string",
    ).withColumn("timestamp", at()))
    first = records.unionByName(odd)
    ledger.append(first, f"{path}/ledger", "a")
    search_index.add(first, f"{path}/index", "a")
    whole = ledger.read(spark, f"{path}/ledger")
    change = spark.createDataFrame([("1", "renamed.txt"), ("3", "important_too.txt")], "id string, source string")
    ledger.append(ledger.update(whole, change, at()), f"{path}/ledger", "b")
    ledger.append(ledger.delete(whole, spark.createDataFrame([("2",)], "id string"), at()), f"{path}/ledger", "c")
    for _ in range(2):  # the same batch again replaces itself
        search_index.add(ledger.read(spark, f"{path}/ledger").where("version > 1"), f"{path}/index", "b")
    whole, index = ledger.read(spark, f"{path}/ledger"), search_index.read(spark, f"{path}/index")
    for text in ("important", "IMPORTANT_MAIL", "john", "inq%iry", "50%_off", "x", "", "%", "a\\b_c", "ünï", "stanbul", "no such text", "renamed.TXT", "_too."):
        wanted = ids(ledger.search(ledger.latest(whole), text))
        assert ids(search_index.search(whole, index, text)) == wanted, text
    assert ids(search_index.search(whole, index, "important")) == ["3"]
    plan = search_index.candidates(index, ["imp", "mpo"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "In(gram, [imp,mpo])" in plan


def test_positions_of_a_busy_moment(spark):
    """A thread with one busy moment, null threads, equal times: positions as a window gives them."""
    rows = spark.range(3000).selectExpr(
        "cast(id AS string) AS id", "CASE WHEN id % 3 < 2 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE cast(id % 11 AS string) END AS thread_id",
        "timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id % 2 AS int)) AS timestamp",
    )
    window = Window.partitionBy("thread_id").orderBy("timestamp", "id")
    wanted = {r.id: r.n for r in rows.withColumn("n", F.row_number().over(window)).collect()}
    assert {r.id: r.position for r in ledger.with_positions(rows).collect()} == wanted
    assert ledger.with_positions(rows.where("false")).count() == 0


def test_order_of_lists(spark):
    """Whole lists over the given events come in their order, not only with the right rows."""
    from intakeloom.plans.views import view

    found = ledger.new_records(view(spark, "/root/testdata/sf0.001", "ledger"))
    newest = [(r.timestamp, r.id) for r in found.select("timestamp", "id").collect()]
    newest.sort(reverse=True)
    assert [(r.timestamp, r.id) for r in ledger.recent(found).collect()] == newest[:50]
    assert [r.id for r in ledger.listing(found).collect()] == [i for _, i in newest[:50]]
    status = [(r.timestamp, r.id) for r in ledger.by_status(found, "completed").collect()]
    assert status == sorted(status, reverse=True) and len(status) > 50
    hits = [(r.timestamp, r.id) for r in ledger.search(found, "user1").collect()]
    assert hits == sorted(hits, reverse=True) and len(hits) == 20
    threads = [(r.thread_id, r.timestamp, r.id) for r in ledger.all_threads(found).collect()]
    assert threads == sorted(threads)


def test_lookup_by_id_skips_row_groups(spark):
    """An id no file holds is looked for in no row group, though it lies between the files' ids."""
    path = shared_folder(spark, "bloom")
    rows = spark.range(20000).selectExpr(
        "sha2(cast(id AS string), 256) AS id", "'s' AS source", "'PDF' AS format", "'order' AS intent", "timestamp '2024-01-01' AS timestamp"
    )
    ledger.append(ledger.new_records(rows.repartition(4)), path)

    def scanned(wanted):
        found = ledger.read(spark, path).where(F.col("id") == wanted)
        count = len(found.collect())
        plan = found._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        return count, sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))

    hit = rows.first().id
    assert scanned("8" + "0" * 63) == (0, 0)
    found, read = scanned(hit)
    assert found == 1 and 0 < read < 20000


def test_postings_do_not_meet_before_they_are_dealt_out(spark):
    rows = [("1", "a.txt", "order", "{}", "ann"), ("1", "a.txt", "order", "{}", "ann")]
    frame = spark.createDataFrame(rows, "id string, source string, intent string, extracted_fields string, sender string")
    found = search_index.postings(frame)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    # of a record that came twice every triple is held once
    index = found.withColumn("bucket", search_index._bucket(F.col("gram")))
    assert search_index.candidates(index, ["ord", "der"]).count() == 1


def test_refused_files_of_many_partitions_are_kept_in_few(spark, tmp_path):
    rows = spark.range(64).repartition(64).selectExpr(
        "CAST(id AS STRING) AS doc_id", "concat('f', id, '.bin') AS source", "id % 2 AS file_size"
    )
    admission.quarantine(admission.check_files(rows), str(tmp_path), "b")
    kept = admission.read_quarantine(spark, str(tmp_path))
    assert {row.reason: row["count"] for row in kept.groupBy("reason").count().collect()} == {"empty": 32, "extension": 32}
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(list(tmp_path.glob("batch=b/reason=*/*.parquet"))) <= 2 * tasks


def test_written_files_lie_in_folders_and_are_found_there_and_above(spark, tmp_path):
    (tmp_path / "above.txt").write_bytes(b"")
    (tmp_path / "read.txt").write_bytes(b"x")
    docs = spark.range(60).selectExpr("concat('f', id, '.txt') AS source", "CASE WHEN id % 3 > 0 THEN CAST('ab' AS BINARY) END AS content")
    assert files.write_files(docs, str(tmp_path)) == 60
    assert len([x for x in tmp_path.iterdir() if x.is_dir()]) > 1
    found = files.scan(spark, str(tmp_path), with_empty=True)
    sizes = {row.source: row.file_size for row in found.select("source", "file_size").collect()}
    assert found.count() == 62
    assert sizes == {f"f{k}.txt": 2 if k % 3 else 0 for k in range(60)} | {"above.txt": 0, "read.txt": 1}
    # a name written again leaves one file
    files.write_files(docs.limit(1), str(tmp_path))
    assert files.scan(spark, str(tmp_path), with_empty=True).count() == 62


def test_scan_in_tasks_finds_what_spark_finds(spark, tmp_path, monkeypatch):
    """Names, globs, hidden files and folders, contents in small batches; the driver lists no file, refused ones are not read."""
    monkeypatch.setattr(files, "BATCH_BYTES", 5)
    for k, name in enumerate(["a.txt", "b c#%.eml", "_hidden.txt", "_x=1.txt", ".dot", "in/d.txt", "in/deep/e.json", "_no/f.txt", "_k=v/g.txt", "in/h.txt._COPYING_", "in/[i].txt", "in/ü.pdf"]):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"%d " % k * k + b"\xe9")
    (tmp_path / "in/empty.txt").write_bytes(b"")
    for glob in ["*", "*.txt", "*.{txt,eml}", "?.txt", "[!a-c].txt", "[^d]*", "\\[i\\].txt", "{a,{d,e}}.*", "no*"]:
        wanted = files.scan(spark, str(tmp_path), glob)
        found = files.scan(spark, str(tmp_path), glob, with_empty=True)
        assert found.columns == wanted.columns
        assert sorted(found.where("file_size > 0").collect()) == sorted(wanted.collect()), glob
    scanned = files.scan(spark, str(tmp_path), with_empty=True)
    assert [tuple(r) for r in scanned.where("file_size = 0").select("source", "content").collect()] == [("empty.txt", b"")]
    plan = plan_of(scanned)
    assert "binaryFile" not in plan and "FileScan" not in plan and "ArrowEvalPython" in plan
    assert "ArrowEvalPython" not in plan_of(admission.quarantined(admission.check_files(scanned)).select("doc_id", "reason"))
