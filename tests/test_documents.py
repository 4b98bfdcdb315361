"""Classification and extraction of single documents, results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from intakeloom.operators import classify, json_docs, mail, pages, quality, replies
from intakeloom.plans.intake import ledger_rows, route_and_extract
from samples import INVOICE, MULTIPART, PLAIN_MAIL


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id int, source string, text string")


def only(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0]


def test_plain_mail(spark):
    row = only(mail.extract_mail(docs(spark, (1, "a.txt", PLAIN_MAIL))))
    assert row.sender == "ann.lee@northwind-labs.com"
    assert row.recipient == "helpdesk@orbit-hosting.com"
    assert row.subject == "URGENT: portal unreachable"
    assert row.body.startswith("Dear team,\n\nthe portal")
    assert "Ann Lee\n(555)" in row.body
    assert row.phone_numbers == ["(555) 222-3333"]
    assert row.monetary_amounts == ["$12,500"]
    assert row.mentioned_dates == ["02/14/2024", "2024-02-15"]
    # "ref" is tried before "reference"
    assert row.reference_numbers == ["2024-17", "erence"]
    assert row.urgency == "high"
    assert row.confidence_score == pytest.approx((0.8 + 0.7) / 2)
    assert json.loads(row.extracted_fields)["main_topic"] == "Unknown"


def test_headers_edge_cases(spark):
    texts = [
        "From: x@a.com\nfrom: nobody\n\nhi there",
        "From: x@a.com\nno blank line here",
        "From: x@a.com\n",
        "\nFrom: x@a.com",
        "Subject: s\r\n\r\n body \r\n end",
    ]
    rows = mail.header_fields(docs(spark, *[(i, "", t) for i, t in enumerate(texts)]))
    got = {r.doc_id: (r.sender, r.subject, r.body) for r in rows.collect()}
    assert got[0] == (None, None, "hi there")
    assert got[1] == ("x@a.com", None, texts[1])
    assert got[2] == ("x@a.com", None, texts[2])
    assert got[3] == (None, None, "From: x@a.com")
    assert got[4] == (None, "s", "body\nend")


def test_no_rush_is_high(spark):
    frame = docs(spark, (1, "", "there is no rush"), (2, "", "when convenient"), (3, "", "hi"))
    got = frame.select("doc_id", mail.urgency(F.lower("text")).alias("u")).collect()
    assert {r.doc_id: r.u for r in got} == {1: "high", 2: "low", 3: "medium"}


def test_multipart(spark):
    frame = docs(spark, (7, "dir/quote.eml", MULTIPART)).withColumn("thread_id", F.lit("t"))
    row = only(mail.pdf_attachments(frame))
    assert row.filename == "list of chairs.pdf"
    assert row.attachment_name == "quote_list of chairs.pdf"
    assert bytes(row.payload) == b"%PDF-1.4 hello"
    assert (row.file_size, row.thread_id) == (14, "t")
    parts = mail.message_parts(frame).collect()
    assert [p.content_type for p in sorted(parts, key=lambda p: p.part_no)][:3] == [
        "multipart/alternative",
        "text/plain",
        "text/html",
    ]


def test_invoice_json(spark):
    row = only(json_docs.extract_json(docs(spark, (1, "i.json", INVOICE))))
    assert (row.detected_schema, row.valid, row.confidence_score) == ("invoice", True, 1.0)
    assert row.invoice.amount == 478.25
    assert row.invoice.customer_phone is None
    assert [i.item_id for i in row.invoice.line_items] == ["C1", "C2"]
    assert row.recommendations == ["JSON processing completed successfully"]


def test_json_validation(spark):
    texts = {
        1: '{"id": 5, "name": "n", "price": true}',
        2: '{"w": {"id": "5", "name": "n", "price": 1}}',
        3: '{"w": {"x": 1}, "id": "5", "name": "n", "price": 1.5}',
        4: "[1]",
        5: "{bad",
        6: '{"header": {"invoice_number": "1"}, "summary": null}',
    }
    rows = json_docs.extract_json(docs(spark, *[(k, "", v) for k, v in texts.items()])).collect()
    got = {r.doc_id: r for r in rows}
    assert got[1].validation_errors == [
        "'id' is not of type string",
        "'price' is not of type number",
    ]
    assert got[2].detected_schema == "product" and got[2].valid
    assert got[3].valid and got[3].product.price == 1.5
    assert got[4].detected_schema == "unknown" and got[4].confidence_score == 0.0
    assert not got[5].success and got[5].error
    assert got[6].validation_errors == [
        "'header.invoice_date' is required",
        "'header.due_date' is required",
        "'summary' is not of type object",
    ]


def test_classification(spark):
    frame = docs(
        spark,
        (1, "a.msg", "x"),
        (2, "b", '{"a": 1}'),
        (3, "c", "From: a@b.com\nSubject: hi"),
        (4, "d", "an rfq: request for quote, quotation request, price inquiry"),
        (5, "e", ""),
    )
    got = {r.doc_id: r for r in classify.classify(frame, name="source").collect()}
    assert [got[i].format for i in range(1, 6)] == ["email", "json", "email", "text", "unknown"]
    assert (got[4].intent, got[4].confidence_score) == ("rfq", 1.0)
    assert got[4].target_agent == "email_agent"
    assert not got[5].success


def test_arbitration_keeps_sure_rules(spark):
    sure = "an rfq: request for quote, quotation request, price inquiry"
    frame = docs(spark, (1, "", sure), (2, "", "a bill"), (3, "", "a bill"), (4, "", "a bill"))
    answers = spark.createDataFrame(
        [(1, "order,0.9"), (2, "order,0.9"), (3, "order,nan"), (4, "order,0.9d")],
        "doc_id int, response string",
    )
    got = {r.doc_id: r.intent for r in classify.classify(frame, answers).collect()}
    assert got == {1: "rfq", 2: "order", 3: "invoice", 4: "invoice"}


def test_repeated_replies_do_not_multiply_documents(spark):
    frame = docs(spark, (1, "", "a bill"))
    answers = spark.createDataFrame([(1, "order,0.9")] * 5, "doc_id int, response string")
    assert classify.classify(frame, answers).count() == 1


def test_category_reply_repair(spark):
    given = [
        ('{"category": "Invoice", "confidence": 0.9}', "x", ("Invoice", 0.9)),
        ('{"category": "?", "confidence": 0.9, "reasoning": "r"}', "an order", ("Order", 0.8)),
        ('{"category": "?", "reasoning": "r"}', "an order", ("Order", 0.4)),
        ('{"category": "?"}', "an order", ("Order", 0.6)),
        ('{"category": "?"}', "nothing", ("Invoice", 0.3)),
        ("no json", "an order", ("Order", 0.6)),
        ('see {"category": "Order", "confidence": 1} end', "x", ("Order", 1.0)),
    ]
    frame = spark.createDataFrame(
        [(i, r, t) for i, (r, t, _) in enumerate(given)], "i int, r string, t string"
    )
    judged = replies.category_reply(F.col("r"), F.col("t"), ["Invoice", "Order"])
    rows = frame.select("i", judged.alias("j")).orderBy("i").collect()
    for row, (_, _, (category, confidence)) in zip(rows, given):
        assert row.j.category == category
        assert row.j.confidence == pytest.approx(confidence)


def test_mail_reply_null_stays_null(spark):
    texts = ['{"main_topic": null}', "```json\n{\"sentiment\": \"x\"}\n```", "angry, need help", "[]"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, r string")
    rows = replies.with_mail_reply(frame, F.col("r")).orderBy("i").collect()
    assert (rows[0].main_topic, rows[0].sender_intent) == (None, "Unknown")
    assert (rows[1].sentiment, rows[1].action_required) == ("x", "Review required")
    assert (rows[2].sentiment, rows[2].sender_intent) == ("negative", "request")
    assert (rows[3].sentiment, rows[3].main_topic) == ("neutral", "Unknown")


def test_pages_in_order(spark):
    rows = [(1, p, f"text {p}") for p in range(12, 0, -1)] + [(2, 1, ""), (2, 2, None)]
    frame = spark.createDataFrame(rows, "doc_id int, page int, text string")
    whole = {r.doc_id: r for r in pages.assemble(frame).collect()}
    expected = "\n".join(f"--- Page {p} ---\ntext {p}" for p in range(1, 13))
    assert whole[1].text == expected and whole[1].page_count == 12
    assert whole[2].text is None and whole[2].page_count == 2
    blocks = {r.doc_id: r for r in pages.assemble(frame, pages_per_block=5).collect()}
    assert blocks == whole
    large = {r.doc_id: r for r in pages.assemble(frame, largest=40).collect()}
    assert (large[1].text, large[1].too_large, large[1].page_count) == (None, True, 12)
    assert not large[2].too_large
    told = {r.doc_id: r for r in pages.extract_pages(pages.assemble(frame, largest=40)).collect()}
    assert (told[1].success, told[1].error, told[1].confidence_score) == (False, pages.TOO_LARGE, 0.0)
    assert (told[2].success, told[2].error, told[2].confidence_score) == (True, "No page text", 0.5)


def test_one_row_for_any_number_of_pages(spark):
    frame = spark.range(1, 5001).selectExpr("1 AS doc_id", "id AS page", "concat('word ', id) AS text")
    answers = spark.createDataFrame([(1, "text only")], "doc_id int, response string")
    for given in (None, answers):
        row = only(pages.extract_pages(pages.assemble(frame), given))
        assert (row.page_count, row.total_lines) == (5000, 10000)


def test_page_fields(spark):
    text = (
        "Complaint No: C-9\nFiled: 2024-01-02\nDetails: late\nand broken\n\n"
        "The case is pending, priority: High\nCompany: Deskworks Inc\n7 Elm Street, Dover\n"
    )
    row = only(pages.extract_pages(docs(spark, (1, "", text)), page_count=None))
    found = json.loads(row.extracted_fields)
    assert row.document_type == "complaint"
    assert found["case_number"] == "C-9"
    assert found["description"] == "late"
    assert found["status"] == "pending"
    assert found["companies"] == ["Deskworks Inc"]
    assert found["addresses"] == ["7 Elm Street, Dover"]
    assert "emails" not in found
    assert row.field_count == len(found)


def test_types_without_patterns_have_no_fields(spark):
    text = "agreement between party A and party B a@b.com"
    row = only(pages.extract_pages(docs(spark, (1, "", text)), page_count=None))
    assert (row.document_type, row.field_count) == ("contract", 0)
    none = only(pages.extract_pages(docs(spark, (1, "", None)), page_count=None))
    assert (none.document_type, none.confidence_score) == ("unknown", 0.5)


def test_required_fields(spark):
    frame = spark.createDataFrame([({"a": "1", "b": " "},), ({},)], "m map<string,string>")
    rows = frame.select(quality.validate_fields(F.col("m"), ["a", "b", "c"]).alias("v")).collect()
    full, empty = rows[0].v, rows[1].v
    assert (full.missing_fields, full.empty_fields) == (["c"], ["b"])
    assert full.confidence_score == pytest.approx((1 - 2 / 3) * 0.75)
    assert empty.confidence_score == 0.0


def test_intake_knows_pages_and_tables(spark):
    frame = docs(spark, (1, "a.pdf", "Invoice Number: N-1\nTotal: $5"), (2, "b.pdf", "Total: $5")).selectExpr(
        "*", "30 AS pages", "doc_id = 1 AS tables"
    )
    plain = {r.doc_id: r for r in route_and_extract(frame).collect()}
    told = {r.doc_id: r for r in route_and_extract(frame, page_count="pages", has_tables="tables").collect()}
    assert told[1].confidence_score == pytest.approx(plain[1].confidence_score + 0.1)
    assert told[2].confidence_score == plain[2].confidence_score
    for row in told.values():
        assert "Consider document summarization for large PDFs" in row.recommendations
    assert told[1].content_md5 == plain[1].content_md5


def test_intake_reads_every_route(spark):
    frame = docs(
        spark,
        (1, "a.txt", PLAIN_MAIL),
        (2, "b.json", INVOICE),
        (3, "c.pdf", "Invoice Number: N-1\nTotal: $5"),
        (4, "d.json", "{bad"),
        (5, "e.txt", "hi"),
        (6, "f.txt", None),
    )
    mail_answers = spark.createDataFrame(
        [(1, '{"main_topic": "Outage", "extra": 1}')], "doc_id int, response string"
    )
    page_answers = spark.createDataFrame(
        [(3, '{"extracted_fields": {"amount": "7"}}')], "doc_id int, response string"
    )
    results = route_and_extract(
        frame, keep=["source"], mail_replies=mail_answers, page_replies=page_answers
    )
    got = {r.doc_id: r for r in results.collect()}
    assert [got[i].success for i in range(1, 7)] == [True, True, True, False, False, False]
    one = json.loads(got[1].extracted_fields)
    assert (one["main_topic"], one["extra"]) == ("Outage", 1)
    assert got[1].confidence_score == pytest.approx((0.8 + 0.7 + 0.9) / 3)
    assert json.loads(got[3].extracted_fields)["amount"] == "7"
    records = ledger_rows(results, F.lit("2024-01-01").cast("timestamp")).collect()
    # unreadable JSON is reported but not recorded
    assert sorted(r.format for r in records) == ["EMAIL", "ERROR", "ERROR", "JSON", "PDF"]


def test_json_values_keep_their_types(spark):
    texts = {
        1: '{"order_id": 9007199254740993, "customer": {"b": [1, 2.5], "a": null}, "items": [], "total": "12.50", "status": null}',
        2: '{"id": "7", "name": true, "price": 3, "category": {}}',
        3: '{"header": {"invoice_number": 77}, "vendor": null, "line_items": [{"quantity": "2"}, 5], "summary": {"total_amount": 1e3}}',
    }
    frame = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {r.doc_id: json.loads(r.extracted_fields) for r in json_docs.extract_json(frame).collect()}
    assert got[1] == json.loads(texts[1])
    assert got[2] == {**json.loads(texts[2]), "description": None}
    assert (got[3]["invoice_number"], got[3]["amount"], got[3]["vendor_phone"]) == (77, 1000, None)
    assert got[3]["line_items"][0]["quantity"] == "2" and got[3]["line_items"][1]["quantity"] is None


def test_json_too_long_to_read(spark):
    """A string beyond the parser's limit ends as a JSON error, not as a mail."""
    frame = spark.range(1).select(
        F.lit("x.txt").alias("source"), F.concat(F.lit('{"a":"'), F.repeat(F.lit("b"), 20_000_100), F.lit('"}')).alias("text"), F.lit(1).alias("doc_id")
    )
    row = only(json_docs.extract_json(frame))
    assert (row.success, row.error, row.extracted_fields) == (False, json_docs.JSON_TOO_LONG, "{}")
    row = only(classify.classify(frame, keep=["source"]))
    assert (row.format, row.target_agent) == ("json", "json_agent")


def test_a_condition_on_the_schema_repeats_no_extraction(spark):
    frame = spark.createDataFrame([("1", INVOICE)], "doc_id string, text string")
    found = json_docs.extract_json(frame).filter("detected_schema = 'invoice'")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("variant_get" in line for line in filters)
    assert found.count() == 1
