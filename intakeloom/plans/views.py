"""Document views over the given tables.

Each view is one SQL text both Spark and the checking engine read, so both see
the same documents.  ``<name>`` stands for a table.  All views are projections
or key joins: they grow with the tables and group nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from intakeloom.sources.tables import table

_DATE = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_KEY = "CAST(o_orderkey AS STRING)"
_WHOLE = "CAST(floor(o_totalprice) AS BIGINT)"
_MONEY = (
    f"concat('$', CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING), ',', "
    f"lpad(CAST({_WHOLE} % 1000 AS STRING), 3, '0'), '.50')"
)
_PHONE = (
    "concat('(', CAST(200 + o_custkey % 700 AS STRING), ') 555-', "
    "lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'))"
)
_DOTTED = (
    "concat('+1 ', CAST(200 + o_custkey % 700 AS STRING), '.555.', "
    "lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'))"
)
_USER = "lower(replace(c_name, '#', '.'))"

# E-mails: headers in odd cases and places, entities, urgency, intent phrases.
MAILS = f"""
SELECT o_orderkey AS doc_id,
       concat('order-', {_KEY}, CASE o_orderstatus WHEN 'F' THEN '.txt' WHEN 'O' THEN '.eml'
              ELSE '' END) AS source,
       CAST(o_custkey AS STRING) AS thread_id,
       o_orderdate AS received_at,
       concat(
         'Date: ', {_DATE}, chr(10),
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN concat('From: the front desk', chr(10))
              ELSE concat('FROM: ', {_USER}, '@mail.example.com', chr(10)) END,
         '  To: Desk <desk@intake.example.org>  ', chr(10),
         CASE WHEN o_orderstatus = 'P'
              THEN concat('From: second.', CAST(o_custkey AS STRING), '@example.net', chr(10))
              ELSE '' END,
         CASE WHEN o_orderpriority = '5-LOW' THEN ''
              ELSE concat('Subject:  Case ', {_KEY}, '  ', chr(10)) END,
         '   ', chr(10),
         '  Dear team,', chr(9), chr(10),
         CASE o_orderstatus
           WHEN 'F' THEN concat('find our invoice: the bill with the amount owed. Payment due: ',
                                {_MONEY}, ', total due $ ', CAST({_WHOLE} AS STRING), '.')
           WHEN 'O' THEN concat('this is a purchase order, order #: PO-', {_KEY},
                                ' for procurement. We buy, please help. Reference 77')
           ELSE concat('there is an issue and a problem, ref: C', {_KEY}, ' of concern. Question?')
         END, chr(10),
         CASE o_orderpriority
           WHEN '1-URGENT' THEN 'This is URGENT.'
           WHEN '2-HIGH' THEN 'Please expedite.'
           WHEN '3-MEDIUM' THEN 'There is no rush.'
           WHEN '5-LOW' THEN 'Answer when convenient.'
           ELSE 'Thanks.' END, chr(10),
         'Call ', {_PHONE}, ' or ', {_DOTTED}, ', again ', {_PHONE}, ' by ', {_DATE}, '.', chr(10),
         'Mail ', {_USER}, '@mail.example.com', chr(10),
         'Best regards,', chr(10), c_name
       ) AS text
FROM <orders> JOIN <customer> ON o_custkey = c_custkey
"""

_ITEM = (
    "concat('{\"item_id\":\"P', CAST(l_partkey AS STRING), '\",\"description\":\"part ', "
    "CAST(l_partkey AS STRING), '\",\"quantity\":', CAST(CAST(l_quantity AS BIGINT) AS STRING), "
    "',\"unit_price\":', CAST(l_extendedprice AS STRING), "
    "',\"total_price\":', CAST(l_extendedprice AS STRING), '}')"
)
_FREIGHT = "'{\"item_id\":\"FREIGHT\",\"quantity\":1,\"note\":\"flat\"}'"
_HEADER = (
    "concat('{\"invoice_number\":\"INV-', CAST(l_orderkey AS STRING), '\",\"invoice_date\":\"', "
    "CAST(CAST(l_shipdate AS DATE) AS STRING), '\",\"due_date\":\"', "
    "CAST(CAST(o_orderdate AS DATE) AS STRING), '\"}')"
)
_VENDOR = (
    "concat('{\"company_name\":\"', s_name, '\",\"contact\":{\"phone\":\"+1-', "
    "CAST(s_suppkey AS STRING), '\",\"email\":\"s', CAST(s_suppkey AS STRING), '@example.com\"}}')"
)
_CLIENT = (
    "concat('{\"company_name\":\"', c_mktsegment, '\",\"contact_person\":\"', c_name, "
    "'\",\"contact\":{\"email\":\"c', CAST(c_custkey AS STRING), '@example.com\"}}')"
)
_INVOICE = (
    f"concat('{{\"header\":', {_HEADER}, ',\"vendor\":', {_VENDOR}, ',\"customer\":', {_CLIENT}, "
    f"',\"line_items\":[', {_ITEM}, ',', {_FREIGHT}, '],\"summary\":{{\"total_amount\":', "
    "CAST(l_extendedprice AS STRING), '}}')"
)

# JSON documents, six kinds by return flag and line status: wrapped invoice,
# flat invoice, order, product, invoice with wrong types, cut-off text.
JSONS = f"""
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-',
              CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS doc_id,
       concat('doc-', CAST(l_orderkey AS STRING), '.json') AS source,
       CAST(o_custkey AS STRING) AS thread_id,
       o_orderdate AS received_at,
       CASE concat(l_returnflag, l_linestatus)
         WHEN 'AF' THEN concat('{{"invoice":', {_INVOICE}, '}}')
         WHEN 'AO' THEN concat(' ', {_INVOICE}, ' ')
         WHEN 'NF' THEN concat('{{"order_id":"', CAST(l_orderkey AS STRING), '","customer":"',
                               c_name, '","items":[', {_ITEM}, '],"total":',
                               CAST(l_extendedprice AS STRING), ',"status":"', l_linestatus, '"}}')
         WHEN 'NO' THEN concat('{{"id":"', CAST(l_partkey AS STRING), '","name":"part","price":',
                               CAST(l_extendedprice AS STRING), ',"category":"',
                               l_returnflag, '"}}')
         WHEN 'RF' THEN concat('{{"header":{{"invoice_number":', CAST(l_orderkey AS STRING),
                               ',"invoice_date":"x"}},"vendor":null,"line_items":',
                               CASE WHEN l_linenumber > 3 THEN '{{}}' ELSE '[]' END,
                               ',"summary":{{"total_amount":"', CAST(l_extendedprice AS STRING),
                               '"}}}}')
         ELSE concat('{{"note":"', c_name, '"', CASE WHEN l_linenumber > 3 THEN '' ELSE '}}' END)
       END AS text
FROM <lineitem>
JOIN <orders> ON l_orderkey = o_orderkey
JOIN <customer> ON o_custkey = c_custkey
JOIN <supplier> ON l_suppkey = s_suppkey
"""

# JSON documents whose values have other types than usual.
TYPED = f"""
SELECT o_orderkey AS doc_id,
       CASE o_orderkey % 4
         WHEN 0 THEN concat('{{"order_id":', CAST(9007199254740993 + o_orderkey AS STRING),
           ',"customer":{{"name":"', o_orderstatus, '","tags":[1,2.25,null,true,"x"]}},"items":[{{"a":[]}},7],"total":"12.50","status":null}}')
         WHEN 1 THEN concat('{{"id":', {_KEY}, ',"name":["n",{{"k":"v"}}],"price":3,"category":false}}')
         WHEN 2 THEN concat('{{"id":"', {_KEY}, '","name":"\u00e9 ', chr(92), '"q', chr(92), '"","price":', {_KEY}, '.125,"category":{{}},"description":0}}')
         ELSE concat('{{"invoice":{{"header":{{"invoice_number":', {_KEY}, ',"invoice_date":true}},"vendor":"none",',
           '"customer":{{"company_name":{{"de":"x"}},"contact":null}},"line_items":[{{"item_id":5,"quantity":"2","unit_price":1.5}},{{}}],',
           '"summary":{{"total_amount":', {_KEY}, '}}}}}}')
       END AS text
FROM <orders>
"""

# Texts of scanned pages: invoice, complaint, rfq, report, contract, plain, none.
PAPERS = f"""
SELECT o_orderkey AS doc_id,
       concat('scan-', {_KEY}, '.pdf') AS source,
       CAST(o_custkey AS STRING) AS thread_id,
       o_orderdate AS received_at,
       CAST(1 + o_orderkey % 30 AS BIGINT) AS page_count,
       CASE o_orderpriority
         WHEN '1-URGENT' THEN concat(
           'INVOICE', chr(10), 'Invoice Number: INV-', {_KEY}, chr(10), 'Date: ', {_DATE}, chr(10),
           'From: Acme & Sons, Ltd', chr(10), 'Bill to: ', c_mktsegment, ' Group', chr(10),
           ' Item A qty 3 at $12', chr(10), 'Quantity 2 of B: $7.50 ', chr(10), 'Note $5', chr(10),
           CASE WHEN o_orderstatus = 'O' THEN '' ELSE concat('Total: ', {_MONEY}, chr(10)) END,
           'Tax: $1,000.25', chr(10), 'Payment to 12 Main Street, Springfield', chr(10),
           'Company: Widget Works', chr(10), {_USER}, '@mail.example.com ', {_PHONE})
         WHEN '2-HIGH' THEN concat(
           'Complaint No: C-', {_KEY}, chr(10), 'Filed: ', {_DATE}, chr(10), 'Name: Jo Roe',
           chr(10), 'Priority: High', chr(10), 'Regarding late parts', chr(10),
           CASE o_orderstatus WHEN 'F' THEN 'Details: broken on arrival, a problem and concern'
                              WHEN 'O' THEN 'The resolve team is pending' ELSE 'Details:   ' END,
           chr(10), '   ', chr(10), 'Case is open. ', {_PHONE}, ' ', {_PHONE})
         WHEN '3-MEDIUM' THEN concat(
           'Request for Quote', chr(10), 'RFQ number: R', {_KEY}, chr(10), 'Deadline: ', {_DATE},
           chr(10), 'Project: line ', {_KEY}, chr(10), 'Contact: desk@example.org', chr(10),
           'Scope: bid and tender for parts', chr(10), chr(10), 'Delivery: in two weeks ', chr(10),
           'A proposal or quotation is welcome')
         WHEN '4-NOT SPECIFIED' THEN concat(
           'Title: Yearly report', chr(10), 'Prepared by Ann Lee', chr(10), 'Date: ', {_DATE},
           chr(10), 'Department: Sales & Service', chr(10), 'Summary of findings and analysis for ',
           c_name, chr(10), 'Conclusion: steady. ', repeat('more words here. ', 40))
         ELSE CASE o_orderstatus
           WHEN 'F' THEN concat('This agreement between party A and party B, whereas terms of ',
                                {_DATE})
           WHEN 'O' THEN concat('Hello ', c_name)
           ELSE '' END
       END AS text
FROM <orders> JOIN <customer> ON o_custkey = c_custkey
"""

# Model replies by order, good and bad ones of every kind.
REPLIES = """
SELECT o_orderkey AS doc_id,
       CASE concat(substr(o_orderpriority, 1, 1), o_orderstatus)
         WHEN '1F' THEN 'invoice,0.85'
         WHEN '1O' THEN ' Order , 1.7 '
         WHEN '1P' THEN 'rfq,0.9,sure'
         WHEN '2F' THEN 'complaint,nan'
         WHEN '2O' THEN 'inquiry,abc'
         WHEN '2P' THEN 'unknown,0.9'
         WHEN '3F' THEN 'weather,0.9'
         WHEN '3O' THEN '{"extracted_fields":{"project":"P7","po":7},"summary":"s"}'
         WHEN '4F' THEN CASE o_orderkey % 5
           WHEN 0 THEN '{"sender":null,"subject":"","main_topic":"Billing"}'
           WHEN 1 THEN '{"subject":"Re: parts","urgency":"low","sender":""}'
           WHEN 2 THEN '{"urgency":null,"subject":null,"sender_intent":"order"}'
           ELSE '{"main_topic":"Billing","sender_intent":"complaint","deadline_mentioned":null,"key_entities":["Acme","Bob"],"ticket":"T1","sender":"model@example.com"}'
         END
         WHEN '4O' THEN concat('```json', chr(10), '{"category":"invoice","confidence":0.9,"reasoning":"bill","extracted_fields":{"amount":"9.99","po":"P7"}}', chr(10), '```')
         WHEN '4P' THEN CASE o_orderkey % 9 WHEN 0 THEN '[]' WHEN 1 THEN '{}' WHEN 2 THEN '77' WHEN 3 THEN '["error"]'
           WHEN 4 THEN '{"error":"quota"}' WHEN 5 THEN '"an error"' WHEN 6 THEN '"fine"' WHEN 7 THEN 'null' ELSE '[1,2]' END
         WHEN '5F' THEN 'I am happy with the request'
         WHEN '5O' THEN 'Sure: {"category":"other","confidence":0.8,"reasoning":"x"} ok'
         WHEN '5P' THEN ''
       END AS response
FROM <orders>
"""

# Multipart messages with a text part and a base64 attachment.
MESSAGES = f"""
SELECT o_orderkey AS doc_id,
       concat('mail-', {_KEY}, '.eml') AS source,
       CAST(o_custkey AS STRING) AS thread_id,
       concat(
         'Content-Type: multipart/mixed; boundary="=b', {_KEY}, '="', chr(10),
         'From: a@example.com', chr(10), chr(10),
         '--=b', {_KEY}, '=', chr(10), 'Content-Type: text/plain', chr(10), chr(10),
         'Dear desk', chr(10),
         '--=b', {_KEY}, '=', chr(10),
         CASE o_orderstatus WHEN 'F' THEN 'Content-Type: application/pdf'
                            WHEN 'O' THEN 'Content-Type: application/x-pdf; charset=x'
                            ELSE 'Content-Type: image/png' END, chr(10),
         'Content-Transfer-Encoding: base64', chr(10),
         'Content-Disposition: attachment;', chr(10), ' filename="scan ', {_KEY}, '.pdf"', chr(10),
         chr(10), <base64>, chr(10),
         '--=b', {_KEY}, '=--', chr(10)
       ) AS text,
       concat('%PDF ', {_KEY}, ' ', o_orderpriority) AS plain
FROM <orders>
"""
_BASE64 = f"base64(CAST(concat('%PDF ', {_KEY}, ' ', o_orderpriority) AS <binary>))"

_NAME = (
    f"CASE o_orderkey % 8 WHEN 5 THEN concat('scan ', {_KEY}, chr(233), '.pdf') "
    f"ELSE concat('scan ', {_KEY}, '.pdf') END"
)
_SAYS_NAME = (
    f"CASE o_orderkey % 8 WHEN 5 THEN concat('filename*=UTF-8', chr(39), chr(39), 'scan%20', {_KEY}, '%C3%A9.pdf') "
    f"WHEN 6 THEN concat('filename*1=\"', {_KEY}, '.pdf\"; filename*0=\"scan \"') "
    f"ELSE concat('filename=\"scan ', {_KEY}, '.pdf\"') END"
)
_PDF_PART = (
    "concat('Content-Type: application/pdf', chr(10), 'Content-Transfer-Encoding: base64', chr(10), "
    f"'Content-Disposition: attachment; ', {_SAYS_NAME}, chr(10), chr(10), <base64>, chr(10))"
)
_TEXT_PART = "concat('Content-Type: text/plain', chr(10), chr(10), 'Dear desk', chr(10))"
_MULTIPART = "concat('Content-Type: multipart/mixed; boundary=\"', b, '\"', chr(10), chr(10))"
_CUT = "concat('--', b, chr(10))"
_CLOSED = "concat('--', b, '--', chr(10))"

# Messages of many shapes, each with one attached page document: a single part,
# a boundary with a blank and network line ends, nested parts, texts around the
# parts and a boundary only a text declares, quoted-printable, an encoded name,
# a split name, a forwarded message.
LETTERS = f"""
SELECT doc_id, source, thread_id, received_at, shape, plain, file,
       CASE WHEN shape = 1 THEN replace(body, chr(10), concat(chr(13), chr(10))) ELSE body END AS text,
       CAST(length(body) AS BIGINT) AS file_size
FROM (
  SELECT doc_id, source, thread_id, received_at, shape, plain, file, concat(
    'From: clerk', thread_id, '@example.com', chr(10), 'Subject: Case ', CAST(doc_id AS STRING), chr(10),
    CASE shape
      WHEN 0 THEN pdf
      WHEN 2 THEN concat({_MULTIPART}, {_CUT}, 'Content-Type: multipart/alternative; boundary=in',
        chr(10), chr(10), '--in', chr(10), {_TEXT_PART}, '--in', chr(10), 'Content-Type: text/html',
        chr(10), chr(10), '<p>Dear desk</p>', chr(10), '--in--', chr(10), {_CUT}, pdf, {_CLOSED})
      WHEN 3 THEN concat({_MULTIPART}, 'Find the invoice attached.', chr(10), {_CUT},
        'Content-Type: text/plain', chr(10), chr(10), 'boundary="y"', chr(10), '--y', chr(10),
        'Dear desk', chr(10), {_CUT}, pdf, {_CLOSED}, 'The end.', chr(10))
      WHEN 4 THEN concat({_MULTIPART}, {_CUT}, 'Content-Type: text/plain; charset=utf-8', chr(10),
        'Content-Transfer-Encoding: quoted-printable', chr(10), chr(10), 'caf=C3=A9 =3D 5=', chr(10),
        '0%', chr(10), {_CUT}, pdf, {_CLOSED})
      WHEN 7 THEN concat({_MULTIPART}, {_CUT}, 'Content-Type: message/rfc822', chr(10), chr(10),
        'Subject: forwarded, please help, it is urgent', chr(10), pdf, {_CLOSED})
      ELSE concat({_MULTIPART}, {_CUT}, {_TEXT_PART}, {_CUT}, pdf, {_CLOSED})
    END) AS body
  FROM (SELECT o_orderkey AS doc_id, concat('letter-', {_KEY}, '.eml') AS source,
               CAST(o_custkey AS STRING) AS thread_id, o_orderdate AS received_at,
               o_orderkey % 8 AS shape, concat('%PDF ', {_KEY}, ' ', o_orderpriority) AS plain,
               {_NAME} AS file, {_PDF_PART} AS pdf, concat('b c=', {_KEY}) AS b
        FROM <orders>) made) shaped
"""

# Page texts of what is attached to letters, known by the hash of its bytes; some are missing.
ENCLOSED = f"""
SELECT md5(plain) AS content_md5, p.text AS text, p.page_count AS page_count
FROM ({LETTERS}) l JOIN ({PAPERS}) p ON l.doc_id = p.doc_id WHERE l.doc_id % 5 <> 0
"""

# Files with names, sizes and times of change, one per document.
FILES = """
SELECT doc_id,
       concat(source, '_', CAST(doc_id AS STRING),
              CASE lang WHEN 'en' THEN '.TXT' WHEN 'de' THEN '.pdf' WHEN 'fr' THEN '.json'
                        ELSE '.docx' END) AS source,
       lang,
       CASE WHEN n_chars > 5000 THEN n_chars * 4000 WHEN n_chars < 300 THEN 0 ELSE n_chars END
         AS file_size,
       CAST('2024-01-01 00:00:00' AS TIMESTAMP) + doc_id * INTERVAL '1' MINUTE AS modified,
       text
FROM <documents>
"""

# Files as they are uploaded: names and contents of every admitted and refused kind.
UPLOADS = """
SELECT doc_id,
       concat('upload_', CAST(doc_id AS STRING), CASE lang WHEN 'de' THEN '.pdf' WHEN 'fr' THEN '.json'
              WHEN 'es' THEN CASE WHEN doc_id % 2 = 0 THEN '.docx' ELSE '' END
              ELSE CASE doc_id % 3 WHEN 0 THEN '.eml' WHEN 1 THEN '.txt' ELSE '.TXT' END END) AS source,
       CASE WHEN doc_id % 13 = 0 THEN ''
            WHEN lang = 'fr' AND doc_id % 2 = 0 THEN concat('{"id":"', CAST(doc_id AS STRING), '","name":"n","price":5}')
            ELSE text END AS text
FROM <documents> WHERE doc_id IS NOT NULL AND text IS NOT NULL
"""

# Texts of every kind in one table, some with a name or a stated format.
MIXED = f"""
SELECT concat('mail-', CAST(doc_id AS STRING)) AS doc_id, source,
       CAST(NULL AS STRING) AS known, text FROM ({MAILS})
UNION ALL
SELECT concat('json-', doc_id) AS doc_id, '' AS source,
       CASE WHEN text LIKE '{{"id"%' THEN 'json' WHEN text LIKE '{{"order%' THEN 'xml' END AS known,
       text FROM ({JSONS})
UNION ALL
SELECT concat('paper-', CAST(doc_id AS STRING)) AS doc_id, source,
       CASE WHEN page_count > 20 THEN 'pdf' END AS known, text FROM ({PAPERS})
UNION ALL
SELECT concat('prose-', CAST(doc_id AS STRING)) AS doc_id, '' AS source,
       CAST(NULL AS STRING) AS known, text FROM <documents>
"""

# Ledger records, one per event.
LEDGER = """
SELECT CAST(event_id AS STRING) AS id,
       concat('event-', CAST(event_id AS STRING),
              CASE event_type WHEN 'view' THEN '.pdf' WHEN 'purchase' THEN '.json' ELSE '.txt' END)
         AS source,
       CASE event_type WHEN 'view' THEN 'PDF' WHEN 'purchase' THEN 'JSON' WHEN 'error' THEN 'ERROR'
                       ELSE 'EMAIL' END AS format,
       CASE event_type WHEN 'view' THEN 'inquiry' WHEN 'purchase' THEN 'order'
                       WHEN 'error' THEN 'error' WHEN 'click' THEN 'rfq' ELSE 'contract' END
         AS intent,
       CAST(ts AS TIMESTAMP) AS timestamp,
       concat('User', CAST(user_id AS STRING), '@example.com') AS sender,
       props AS extracted_fields,
       CAST(user_id AS STRING) AS thread_id,
       CASE event_type WHEN 'view' THEN 'pdf_agent' WHEN 'purchase' THEN 'json_agent'
                       ELSE 'email' END AS processed_by,
       value / 1000 AS confidence_score,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'completed'
                       WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'failed'
                       ELSE 'pending' END AS status,
       CAST(floor(value * 10) AS BIGINT) AS file_size,
       CASE WHEN event_type = 'signup' THEN 0.0 ELSE value END AS processing_time
FROM <events>
"""

ALL = {
    "mails": MAILS,
    "jsons": JSONS,
    "typed": TYPED,
    "papers": PAPERS,
    "replies": REPLIES,
    "messages": MESSAGES.replace("<base64>", _BASE64),
    "letters": LETTERS.replace("<base64>", _BASE64),
    "enclosed": ENCLOSED.replace("<base64>", _BASE64),
    "files": FILES,
    "uploads": UPLOADS,
    "mixed": MIXED,
    "ledger": LEDGER,
}

_JSONS_JOINED = """FROM <lineitem>
JOIN <orders> ON l_orderkey = o_orderkey
JOIN <customer> ON o_custkey = c_custkey
JOIN <supplier> ON l_suppkey = s_suppkey"""
# The same rows for Spark: orders meet their customers before the many lines, which move
# once for both; of the suppliers, few and narrow, every task gets a copy, so that
# lines neither move again nor take the names along.  Of times and quantities only what the
# texts show moves: days and whole numbers, which pack better.
_JSONS_FEWER_MOVES = """FROM (SELECT /*+ BROADCAST(s) */ * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(l_quantity AS BIGINT) AS l_quantity, l_extendedprice, l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS l_shipdate
  FROM <lineitem>)
JOIN (SELECT * FROM <orders> JOIN <customer> ON o_custkey = c_custkey) ON l_orderkey = o_orderkey
JOIN (SELECT s_suppkey, s_name FROM <supplier>) s ON l_suppkey = s_suppkey)"""

#: Views of orders alone whose rows take far longer to work on than to read.
_SPREAD = ("letters",)

_TABLE = re.compile(r"<([a-z]+)>(?=[\s)]|$)")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view over the Parquet tables of a data folder."""
    sql = ALL[name].replace("<binary>", "BINARY").replace(_JSONS_JOINED, _JSONS_FEWER_MOVES)
    for used in sorted(set(_TABLE.findall(sql))):
        rows = table(spark, folder, used)
        if name in _SPREAD:
            # a few megabytes of narrow rows become long messages: dealt out before, so that all tasks share the work
            tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
            rows = rows.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").repartition(tasks, "o_orderkey")
        rows.createOrReplaceTempView(f"intakeloom_{used}")
    return spark.sql(_TABLE.sub(r"intakeloom_\1", sql))


def oracle_view(name: str) -> str:
    """The same view as a query over tables that are known by name."""
    return _TABLE.sub(r"\1", ALL[name].replace("<binary>", "BLOB"))
