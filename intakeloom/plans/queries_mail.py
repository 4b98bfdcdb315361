"""Queries over e-mails."""

from __future__ import annotations

from pyspark.sql import functions as F

from intakeloom import fixed_values as fv
from intakeloom.operators import ledger, mail, mime, replies
from intakeloom.plans import oracle_text as o
from intakeloom.plans.intake import ledger_rows, route_and_extract
from intakeloom.plans.registry import joined, query, stamp
from intakeloom.plans.views import view
from intakeloom.session import shared_folder
from intakeloom.sources import tables

MAILS = o.source("mails")
REPLIES = o.source("replies")
MESSAGES = o.source("messages")
PARSED = o.mail_parsed(MAILS)


@query(
    "e01_input_gate",
    f"SELECT doc_id, coalesce(length({o.trim('response')}) >= 10, false) AS valid FROM {REPLIES}",
)
def input_gate(spark, folder):
    return view(spark, folder, "replies").select(
        "doc_id", mail.is_valid_input(F.col("response")).alias("valid")
    )


@query("e02_headers", f"SELECT doc_id, sender, recipient, subject FROM {PARSED}")
def headers(spark, folder):
    docs = view(spark, folder, "mails").select("doc_id", "text")
    return mail.header_fields(docs).select("doc_id", "sender", "recipient", "subject")


@query("e03_body", f"SELECT doc_id, body FROM {PARSED}")
def body(spark, folder):
    docs = view(spark, folder, "mails").select("doc_id", "text")
    return mail.header_fields(docs).select("doc_id", "body")


@query(
    "e03_body_of_prose",
    f"SELECT doc_id, md5(body) AS body_md5 FROM {o.mail_parsed('documents')}",
)
def body_of_prose(spark, folder):
    docs = tables.table(spark, folder, "documents").select("doc_id", "text")
    return mail.header_fields(docs).select("doc_id", F.md5("body").alias("body_md5"))


@query(
    "e04_first_address",
    f"SELECT doc_id, nullif({o.extract('text', fv.EMAIL_ADDRESS)}, '') AS address FROM documents",
)
def first_address(spark, folder):
    return tables.table(spark, folder, "documents").select(
        "doc_id", mail.address(F.col("text")).alias("address")
    )


def _entity(name: str, column: str):
    """One entity kind over the mails and over the documents."""

    def of(table: str) -> str:
        return f"SELECT doc_id, {o.sorted_set(o.ENTITIES[column])} AS found FROM {table}"

    @query(name, of(MAILS))
    def over_mails(spark, folder):
        docs = view(spark, folder, "mails")
        found = mail.entity_columns(F.col("text"))[column]
        return docs.select("doc_id", joined(found, sort=True).alias("found"))

    @query(f"{name}_in_prose", of("documents"))
    def over_documents(spark, folder):
        docs = tables.table(spark, folder, "documents")
        found = mail.entity_columns(F.col("text"))[column]
        return docs.select("doc_id", joined(found, sort=True).alias("found"))


_entity("e05_addresses", "mentioned_emails")
_entity("e06_phones", "phone_numbers")
_entity("e07_dates", "mentioned_dates")
_entity("e08_amounts", "monetary_amounts")
_entity("e09_references", "reference_numbers")


@query(
    "e06_phone_prefixes",
    f"""SELECT doc_id, {o.sorted_set(f"list_transform({o.every('text', fv.MAIL_PHONE, 1)}, lambda p: coalesce(p, ''))")}
        AS found FROM {MAILS}""",
)
def phone_prefixes(spark, folder):
    """The country prefixes only, as the list of groups gives them."""
    return view(spark, folder, "mails").select(
        "doc_id", joined(mail.phones(F.col("text"), group=1), sort=True).alias("found")
    )


@query(
    "e10_urgency",
    f"SELECT urgency, count(*) AS mails FROM (SELECT {o.URGENCY} AS urgency FROM {MAILS}) GROUP BY 1",
)
def urgency(spark, folder):
    return (
        view(spark, folder, "mails")
        .select(mail.urgency(F.lower("text")).alias("urgency"))
        .groupBy("urgency")
        .agg(F.count("*").alias("mails"))
    )


_CLEAN = (
    "regexp_replace(regexp_replace(regexp_replace("
    + o.trim("response")
    + ", '^```json', ''), '^```', ''), '```$', '')"
)
_SAID = f"""(SELECT *, CASE WHEN json_valid(part) THEN TRY_CAST(part AS JSON) END AS rj,
      coalesce(length(response) > 0 AND NOT json_valid(part), false) AS is_text
    FROM (SELECT *, {o.trim(_CLEAN)} AS part FROM {REPLIES}))"""
_HINT = o.first_set("lower(response)", fv.SENDER_INTENT_WORDS)
_MOOD = f"coalesce({o.first_set('lower(response)', fv.SENTIMENT_WORDS)}, 'neutral')"


def _given(key: str, default: str) -> str:
    """A key of the reply when it is there, null included, else the default."""
    return (
        f"CASE WHEN json_type(rj) = 'OBJECT' AND json_exists(rj, '$.{key}') "
        f"THEN rj->>'$.{key}' ELSE {default} END"
    )


_FACTS = f"""(SELECT doc_id, {_given('main_topic', "'Unknown'")} AS main_topic,
      CASE WHEN is_text THEN coalesce({_HINT}, 'Unknown')
           ELSE {_given('sender_intent', "'Unknown'")} END AS sender_intent,
      CASE WHEN json_type(rj, '$.key_entities') = 'ARRAY'
           THEN array_to_string(CAST(json_extract(rj, '$.key_entities') AS VARCHAR[]), '|')
           ELSE '' END AS key_entities,
      {_given('action_required', "'Review required'")} AS action_required,
      {_given('deadline_mentioned', 'NULL')} AS deadline_mentioned,
      CASE WHEN is_text THEN {_MOOD} ELSE {_given('sentiment', "'neutral'")} END AS sentiment,
      rj->>'$.ticket' AS ticket, {', '.join(
          f"coalesce(json_type(rj) = 'OBJECT' AND json_exists(rj, '$.{c}'), false) AS says_{c}, "
          f"rj->>'$.{c}' AS said_{c}" for c in ('sender', 'subject', 'urgency'))}
    FROM {_SAID})"""
_REPLY_COLUMNS = (
    "main_topic, sender_intent, key_entities, action_required, deadline_mentioned, sentiment"
)


@query("e11_structured_replies", f"SELECT doc_id, {_REPLY_COLUMNS} FROM {_FACTS}")
def structured_replies(spark, folder):
    said = replies.with_mail_reply(view(spark, folder, "replies"), F.col("response"))
    return said.select(
        "doc_id",
        *[
            joined(c).alias(c) if c == "key_entities" else F.col(c)
            for c in fv.MAIL_REPLY_DEFAULTS
        ],
    )


@query(
    "e12_reply_hints",
    f"SELECT doc_id, {_MOOD} AS sentiment, {_HINT} AS sender_intent FROM (SELECT *, text AS response FROM {MAILS})",
)
def reply_hints(spark, folder):
    hints = replies.mail_hints(F.col("text"))
    return view(spark, folder, "mails").select(
        "doc_id", *[value.alias(name) for name, value in hints.items()]
    )


def _extracted(spark, folder):
    docs = view(spark, folder, "mails").select("doc_id", "text")
    return mail.extract_mail(docs, view(spark, folder, "replies"))


_MERGED = f"""(SELECT m.* EXCLUDE (sender, subject), f.* EXCLUDE (doc_id),
      CASE WHEN says_sender THEN said_sender ELSE m.sender END AS sender,
      CASE WHEN says_subject THEN said_subject ELSE m.subject END AS subject,
      CASE WHEN says_urgency THEN said_urgency ELSE {o.URGENCY} END AS urgency
    FROM {PARSED} m LEFT JOIN {_FACTS} f ON m.doc_id = f.doc_id)"""


@query(
    "e13_merged_fields",
    f"SELECT doc_id, sender, subject, urgency, main_topic, ticket, sentiment FROM {_MERGED}",
)
def merged_fields(spark, folder):
    """Read back the merged JSON: a reply's sender replaces the header's."""
    fields = _extracted(spark, folder).select("doc_id", "extracted_fields")
    read = F.from_json(
        "extracted_fields",
        "sender string, subject string, urgency string, main_topic string, ticket string, "
        "sentiment string",
    )
    return fields.select("doc_id", read.alias("f")).select("doc_id", "f.*")


@query(
    "e14_confidence",
    f"SELECT doc_id, {o.mail_confidence('main_topic', 'sender_intent')} AS confidence_score FROM {_MERGED}",
)
def confidence(spark, folder):
    return _extracted(spark, folder).select(
        "doc_id", F.round("confidence_score", 6).alias("confidence_score")
    )


_TYPE = (
    "CASE WHEN contains(text, 'application/pdf') THEN 'application/pdf' "
    "WHEN contains(text, 'application/x-pdf') THEN 'application/x-pdf' ELSE 'image/png' END"
)


@query(
    "e15_message_parts",
    f"""SELECT doc_id, CAST(0 AS BIGINT) AS part_no, 'text/plain' AS content_type,
          CAST(NULL AS STRING) AS filename, md5('Dear desk') AS payload_md5 FROM {MESSAGES}
        UNION ALL
        SELECT doc_id, CAST(1 AS BIGINT), {_TYPE}, 'scan ' || CAST(doc_id AS STRING) || '.pdf',
          md5(plain) FROM {MESSAGES}""",
)
def message_parts(spark, folder):
    docs = view(spark, folder, "messages").select("doc_id", "text")
    return mail.message_parts(docs).select(
        "doc_id", "part_no", "content_type", "filename", F.md5("payload").alias("payload_md5")
    )


@query(
    "e16_attachments",
    f"""SELECT doc_id, thread_id, 'mail-' || CAST(doc_id AS STRING) || '_scan ' ||
          CAST(doc_id AS STRING) || '.pdf' AS attachment_name,
        CAST(length(plain) AS BIGINT) AS file_size, md5(plain) AS content_md5 FROM {MESSAGES}
        WHERE contains(text, 'application/')""",
)
def attachments(spark, folder):
    docs = view(spark, folder, "messages").select("doc_id", "source", "thread_id", "text")
    return mail.pdf_attachments(docs).select(
        "doc_id", "thread_id", "attachment_name", "file_size", "content_md5"
    )


LETTERS = o.source("letters")
# By shape: number, type, whether the file's name is there, payload.
_TREES = """(VALUES
  (0, 0, 'application/pdf', true, '<plain>'),
  (1, 0, 'multipart/mixed', false, NULL), (1, 1, 'text/plain', false, 'Dear desk'), (1, 2, 'application/pdf', true, '<plain>'),
  (2, 0, 'multipart/mixed', false, NULL), (2, 1, 'multipart/alternative', false, NULL),
  (2, 2, 'text/plain', false, 'Dear desk'), (2, 3, 'text/html', false, '<p>Dear desk</p>'), (2, 4, 'application/pdf', true, '<plain>'),
  (3, 0, 'multipart/mixed', false, NULL), (3, 1, 'text/plain', false, 'boundary="y"' || chr(10) || '--y' || chr(10) || 'Dear desk'),
  (3, 2, 'application/pdf', true, '<plain>'),
  (4, 0, 'multipart/mixed', false, NULL), (4, 1, 'text/plain', false, 'caf' || chr(233) || ' = 50%'),
  (4, 2, 'application/pdf', true, '<plain>'),
  (5, 0, 'multipart/mixed', false, NULL), (5, 1, 'text/plain', false, 'Dear desk'), (5, 2, 'application/pdf', true, '<plain>'),
  (6, 0, 'multipart/mixed', false, NULL), (6, 1, 'text/plain', false, 'Dear desk'), (6, 2, 'application/pdf', true, '<plain>'),
  (7, 0, 'multipart/mixed', false, NULL), (7, 1, 'message/rfc822', false, NULL), (7, 2, 'application/pdf', true, '<plain>')
) t(shape, part_no, content_type, named, payload)"""


@query(
    "e15_part_tree",
    f"""SELECT doc_id, CAST(part_no AS BIGINT) AS part_no, content_type, CASE WHEN named THEN file END AS filename,
        md5(CASE payload WHEN '<plain>' THEN plain ELSE payload END) AS payload_md5
        FROM {LETTERS} JOIN {_TREES} USING (shape)""",
)
def part_tree(spark, folder):
    """Letters of all shapes with every part, the letter itself first."""
    parts = mime.message_parts(view(spark, folder, "letters").select("doc_id", "text"))
    return parts.select(
        "doc_id", "part_no", "content_type", "filename", F.md5("payload").alias("payload_md5")
    )


@query(
    "e16_attachments_of_all_shapes",
    f"""SELECT doc_id, thread_id, 'letter-' || CAST(doc_id AS STRING) || '_' || file AS attachment_name,
        CAST(strlen(plain) AS BIGINT) AS file_size, md5(plain) AS content_md5 FROM {LETTERS}""",
)
def attachments_of_all_shapes(spark, folder):
    docs = view(spark, folder, "letters").select("doc_id", "source", "thread_id", "text")
    return mime.pdf_attachments(docs).select(
        "doc_id", "thread_id", "attachment_name", "file_size", "content_md5"
    )


_ENCLOSED = f"""(SELECT l.doc_id, l.thread_id, l.file, l.plain, p.text, p.page_count
  FROM {LETTERS} l LEFT JOIN {o.source('enclosed')} p ON md5(l.plain) = p.content_md5)"""
_PAGE_WORDS = o.STATISTICS["total_words"]
_WITH_ATTACHED = f"""(SELECT doc_id, NULL AS attached_to, source, 'EMAIL' AS format, rule_intent AS intent, thread_id,
    {o.mail_confidence()} AS confidence_score, 'completed' AS status, 'email' AS processed_by, file_size
  FROM (SELECT * REPLACE (CAST(doc_id AS STRING) AS doc_id) FROM {o.mail_parsed(o.ruled(LETTERS))})
  UNION ALL
  SELECT CAST(p.doc_id AS STRING) || '#1', CAST(p.doc_id AS STRING), 'letter-' || CAST(p.doc_id AS STRING) || '_' || file, 'PDF',
    m.rule_intent, p.thread_id, {o.page_confidence(_PAGE_WORDS, o.FIELD_COUNT, 'false')}, 'completed', 'pdf_agent',
    CAST(strlen(plain) AS BIGINT)
  FROM {o.page_fields(o.typed(_ENCLOSED))} p JOIN (SELECT doc_id, rule_intent FROM {o.ruled(LETTERS)}) m ON m.doc_id = p.doc_id)"""


def _with_attachments(spark, folder):
    return route_and_extract(
        view(spark, folder, "letters"),
        keep=["source", "thread_id", "received_at", "file_size"],
        attachment_pages=view(spark, folder, "enclosed"),
    )


@query(
    "c19_mails_with_attachments",
    f"""SELECT doc_id, attached_to, source, lower(format) AS route, intent, thread_id, confidence_score, true AS success,
        file_size FROM {_WITH_ATTACHED}""",
)
def mails_with_attachments(spark, folder):
    """Results of mails and of what is attached to them, in one pass over the mails."""
    return _with_attachments(spark, folder).select(
        "doc_id", "attached_to", "source", "route", "intent", "thread_id",
        F.round("confidence_score", 6).alias("confidence_score"), "success", "file_size",
    )


@query(
    "e16_attachment_ledger",
    f"""SELECT thread_id, source, format, status, processed_by, file_size FROM {_WITH_ATTACHED}""",
)
def attachment_ledger(spark, folder):
    """A mail and its attachment both have a record in a ledger, in one thread."""
    path = shared_folder(spark, "attachments")
    at = F.col("received_at").cast("timestamp")
    ledger.append(ledger_rows(_with_attachments(spark, folder), at), path)
    records = ledger.latest(ledger.read(spark, path))
    return records.select("thread_id", "source", "format", "status", "processed_by", "file_size")


_SETS = ", ".join(f"{o.sorted_set(sql)} AS {name}" for name, sql in o.ENTITIES.items())


@query(
    "e17_mail_records",
    f"""SELECT doc_id, sender, recipient, subject, md5(body) AS body_md5, {_SETS},
        urgency, {_REPLY_COLUMNS},
        {o.mail_confidence('main_topic', 'sender_intent')} AS confidence_score, true AS success
        FROM {_MERGED}""",
)
def mail_records(spark, folder):
    full = _extracted(spark, folder)
    return full.select(
        "doc_id",
        "sender",
        "recipient",
        "subject",
        F.md5("body").alias("body_md5"),
        *[joined(c, sort=True).alias(c) for c in mail.ENTITY_FIELDS],
        "urgency",
        *[
            joined(c).alias(c) if c == "key_entities" else F.col(c)
            for c in fv.MAIL_REPLY_DEFAULTS
        ],
        F.round("confidence_score", 6).alias("confidence_score"),
        "success",
    )


@query(
    "e17_mail_ledger",
    f"""SELECT source, 'EMAIL' AS format, rule_intent AS intent, thread_id,
        {o.stamp('received_at')} AS timestamp, {o.mail_confidence()} AS confidence_score,
        'completed' AS status, 'email' AS processed_by
        FROM {o.mail_parsed(o.ruled(MAILS))}""",
)
def mail_ledger(spark, folder):
    docs = view(spark, folder, "mails")
    results = route_and_extract(docs, keep=["source", "thread_id", "received_at"])
    at = F.col("received_at").cast("timestamp")
    return ledger_rows(results, at).select(
        "source",
        "format",
        "intent",
        "thread_id",
        stamp("timestamp").alias("timestamp"),
        F.round("confidence_score", 6).alias("confidence_score"),
        "status",
        "processed_by",
    )
