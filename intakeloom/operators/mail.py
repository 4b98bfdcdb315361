"""E-mail extraction: headers, body, entities, urgency, attachments, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intakeloom import fixed_values as fv
from intakeloom.functions.jsontext import fields as variant_fields
from intakeloom.functions.text import (
    all_matches,
    first_match,
    first_word_set,
    has,
    lowered,
    null_if_empty,
    quick,
    strip,
)
from intakeloom.operators import mime
from intakeloom.operators.replies import one_reply_each, with_mail_reply

# What a phone number can start with.
PHONE_START = r"+(\d"

INVALID_INPUT = "Agent processing: Invalid email input"

# The first line with nothing but blanks ends the headers.
BLANK_LINE = r"(?Udm)^[^\S\n]*\n"


def is_valid_input(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) >= fv.MIN_MAIL_CHARS, F.lit(False))


# -------------------------------------------------------- headers and entities


def address(text: Column) -> Column:
    """First e-mail address in a text, else null."""
    return F.when(has(text, "@"), first_match(text, fv.EMAIL_ADDRESS))


def header_block(sections: Column) -> Column:
    return F.get(sections, F.lit(0))


def header_line(block: Column, header: str) -> Column:
    """What follows the header's name on the last line that starts with it."""
    lines = all_matches(
        block, rf"^[^\S\n]*{header}:([^\n]*)", 1, ignore_case=True, multiline=True
    )
    return F.try_element_at(lines, F.lit(-1))


def sections(text: Column) -> Column:
    """The text cut at the first blank line: headers and, if any, the rest."""
    return F.split(text, BLANK_LINE, 2)


def body(text: Column, cut: Column) -> Column:
    rest = F.get(cut, F.lit(1))
    lines = F.transform(F.split(rest, "\n"), lambda line: strip(line))
    return F.when(rest.isNull(), text).otherwise(F.array_join(lines, "\n"))


def header_fields(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add sender, recipient, subject and body."""
    cut = docs.withColumn("_cut", sections(F.col(text)))
    block = header_block(F.col("_cut"))
    lines = cut.withColumns(
        {
            "_from": header_line(block, "from"),
            "_to": header_line(block, "to"),
            "subject": strip(header_line(block, "subject")),
            "body": body(F.col(text), F.col("_cut")),
        }
    )
    first = f"(?Ud){fv.EMAIL_ADDRESS}"
    return lines.withColumns(
        {
            "sender": F.nullif(F.regexp_extract("_from", first, 0), F.lit("")),
            "recipient": F.nullif(F.regexp_extract("_to", first, 0), F.lit("")),
        }
    ).drop("_cut", "_from", "_to")


def emails(text: Column) -> Column:
    return F.array_distinct(all_matches(text, fv.EMAIL_ADDRESS, only_if=has(text, "@")))


def phones(text: Column, group: int = 0) -> Column:
    """Distinct phone numbers; ``group=1`` gives the country prefixes instead."""
    return F.array_distinct(all_matches(text, quick(fv.MAIL_PHONE, PHONE_START), group))


def dates(text: Column) -> Column:
    slashed = has(text, "/") | has(text, "-")
    return F.array_distinct(all_matches(text, quick(f"(?:{fv.MAIL_DATE})", r"\d"), only_if=slashed))


def amounts(text: Column) -> Column:
    return F.array_distinct(all_matches(text, fv.MAIL_MONEY, only_if=has(text, "$")))


def references(text: Column) -> Column:
    return F.array_distinct(all_matches(text, quick(fv.MAIL_REFERENCE), 1, ignore_case=True))


def entity_columns(text: Column, phone_group: int = 0) -> dict[str, Column]:
    return {
        "mentioned_emails": emails(text),
        "phone_numbers": phones(text, phone_group),
        "mentioned_dates": dates(text),
        "monetary_amounts": amounts(text),
        "reference_numbers": references(text),
    }


def entities(docs: DataFrame, text: str = "text", phone_group: int = 0) -> DataFrame:
    return docs.withColumns(entity_columns(F.col(text), phone_group))


def urgency(lower_text: Column) -> Column:
    """Level of the first word list with a hit; plain mail is ``medium``."""
    return F.coalesce(first_word_set(lower_text, fv.URGENCY_WORDS), F.lit("medium"))


# ------------------------------------------------------------------ confidence


def confidence(sender: Column, subject: Column, topic: Column, intent: Column) -> Column:
    """Mean score of the facts that were found, 0.5 when none was."""

    def given(value: Column) -> Column:
        return F.coalesce(F.length(value) > 0, F.lit(False))

    def named(value: Column) -> Column:
        return given(value) & (value != "Unknown")

    present = {
        "sender": given(sender),
        "subject": given(subject),
        "topic": named(topic),
        "intent": named(intent),
    }
    total, count = F.lit(0.0), F.lit(0)
    for factor, score in fv.MAIL_FACTORS.items():
        total = total + F.when(present[factor], F.lit(score)).otherwise(F.lit(0.0))
        count = count + present[factor].cast("int")
    return F.when(count == 0, F.lit(fv.MAIL_NO_FACTORS)).otherwise(
        F.least(F.lit(1.0), total / F.greatest(count, F.lit(1)))
    )


# ------------------------------------------------------------------ full record

HEADER_FIELDS = ["sender", "recipient", "subject", "body"]
ENTITY_FIELDS = [
    "mentioned_emails",
    "phone_numbers",
    "mentioned_dates",
    "monetary_amounts",
    "reference_numbers",
]

FACTS = [*HEADER_FIELDS, *ENTITY_FIELDS, "urgency", "mail_ok"]


def mail_facts(docs: DataFrame, text: str = "text", phone_group: int = 0) -> DataFrame:
    """Headers, body, entities and urgency of each mail; the text itself is dropped."""
    found = header_fields(docs, text).withColumns(
        {
            **entity_columns(F.col(text), phone_group),
            "urgency": urgency(lowered(F.col(text))),
            "mail_ok": is_valid_input(F.col(text)),
        }
    )
    return found.drop(text)


def merged_fields(extras: Column) -> Column:
    """All extracted fields as JSON text; what a reply says comes last and wins."""
    known = F.struct(*HEADER_FIELDS, *ENTITY_FIELDS, "urgency", *fv.MAIL_REPLY_DEFAULTS)
    base = variant_fields(F.to_variant_object(known))
    merged = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(extras, k)), extras)
    options = {"ignoreNullFields": "false"}
    return F.when(F.size(extras) > 0, F.to_json(merged, options)).otherwise(
        F.to_json(known, options)
    )


def said_or_found(name: str) -> Column:
    """What a reply says of a field, null included, else what was found in the mail."""
    extras = F.col("reply_extras")
    said = F.try_variant_get(F.try_element_at(extras, F.lit(name)), "$", "string")
    return F.when(
        F.coalesce(F.map_contains_key(extras, F.lit(name)), F.lit(False)), said
    ).otherwise(F.col(name))


def with_reply(facts: DataFrame, response: Column) -> DataFrame:
    """Complete mail facts with a model reply (null for none) and score what then stands."""
    score = confidence(
        F.col("sender"), F.col("subject"), F.col("main_topic"), F.col("sender_intent")
    )
    accepted = F.col("mail_ok")
    merged = with_mail_reply(facts, response).withColumn(
        "extracted_fields", merged_fields(F.col("reply_extras"))
    )
    return (
        merged.withColumns({name: said_or_found(name) for name in ("sender", "subject", "urgency")})
        .withColumns(
            {
                "confidence_score": F.when(accepted, score).otherwise(F.lit(0.0)),
                "success": accepted,
                "error": F.when(~accepted, F.lit(INVALID_INPUT)),
            }
        )
        .drop("reply_extras", "mail_ok")
    )


def extract_mail(
    docs: DataFrame,
    replies: DataFrame | None = None,
    key: str = "doc_id",
    text: str = "text",
    phone_group: int = 0,
) -> DataFrame:
    """The full extraction row of each e-mail.

    Columns of ``docs`` other than the text are kept.  Without a reply table
    the six reply fields hold their defaults.
    """
    facts = mail_facts(docs, text, phone_group)
    if replies is None:
        return with_reply(facts, F.lit(None).cast("string"))
    joined = facts.join(one_reply_each(replies, key), key, "left")
    return with_reply(joined, F.col("response")).drop("response")


# ------------------------------------------------------------------ attachments


def message_parts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The MIME parts inside each message, numbered from 0, depth first.

    See :func:`intakeloom.operators.mime.message_parts`, which also gives the
    message itself.
    """
    inside = mime.message_parts(docs, text).where("part_no > 0")
    return inside.withColumn("part_no", F.col("part_no") - 1).drop("uncut")


def pdf_attachments(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str | None = "source"
) -> DataFrame:
    """PDF attachments as documents of their own, in the thread of their mail.

    The name is prefixed with the mail's own when the mail has a source name.
    """
    return mime.pdf_attachments(docs, text, source)
