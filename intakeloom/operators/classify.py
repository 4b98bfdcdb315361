"""Format detection, intent scoring, reply arbitration and routing.

All of it is a narrow projection of the documents.  Only the verdict columns,
never the text, take part in the join with model replies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intakeloom import fixed_values as fv
from intakeloom.functions import jsontext, names
from intakeloom.functions.keywords import best_label
from intakeloom.functions.text import has_any, has_match, lowered, preview
from intakeloom.operators.replies import intent_reply, one_reply_each
from intakeloom.functions.stages import computed_once

INVALID_INPUT = "Agent processing: Invalid input data"


def is_valid_input(text: Column) -> Column:
    return F.coalesce(F.length(text) > 0, F.lit(False))


def mail_marks(lower_text: Column) -> Column:
    """How many of the five e-mail marks the lower-cased text shows."""
    total = F.lit(0)
    for words, mark in zip(fv.MAIL_MARK_WORDS, fv.MAIL_MARKS):
        # a quick word test first: most texts need no regular expression
        test = has_any(lower_text, words)
        if not words[0].startswith(("subject", "sincerely")):
            test = test & has_match(lower_text, mark)
        total = total + test.cast("int")
    return total


def is_mail(lower_text: Column) -> Column:
    return F.coalesce(mail_marks(lower_text) >= 2, F.lit(False))


def format_of_name(name: Column) -> Column:
    return names.lookup(names.extension(names.base_name(name)), fv.FORMAT_BY_EXTENSION)


def with_format(
    docs: DataFrame,
    text: str = "text",
    lower_text: str = "_lower",
    name: str | None = None,
    known: str | None = None,
    to: str = "_format",
) -> DataFrame:
    """Add the format: known one, else by the name's extension, else by content.

    A known format that is not one of ours goes straight to the content, which
    is read only where nothing else decided.
    """
    choices = []
    if known is not None:
        upper = F.upper(known)
        choices.append(F.when(upper.isin(fv.KNOWN_FORMATS), upper))
    if name is not None:
        by_name = format_of_name(F.col(name))
        if known is not None:
            by_name = F.when(F.coalesce(F.length(known), F.lit(0)) == 0, by_name)
        choices.append(by_name)
    stated = F.coalesce(*choices) if choices else F.lit(None).cast("string")
    undecided = docs.withColumn("_stated", stated)
    open_text = F.when(F.col("_stated").isNull(), F.col(text))
    read = computed_once(undecided, "_frame", jsontext.framed(open_text))
    is_json = F.coalesce(jsontext.is_closed(F.col("_frame")), F.lit(False)) | jsontext.beyond_parser(F.col(text))
    by_marks = F.when(is_mail(F.col(lower_text)), "EMAIL").otherwise("TEXT")
    fmt = F.coalesce("_stated", F.when(is_json, "JSON").otherwise(by_marks))
    return computed_once(read, to, fmt).drop("_stated", "_frame")


def with_rule_intent(docs: DataFrame, lower_text: str) -> DataFrame:
    """Add ``rule_intent`` and ``rule_confidence`` from the phrase lists."""
    scored = computed_once(
        docs, "_best", best_label(F.col(lower_text), fv.INTENT_PHRASES, share=True)
    )
    intent, confidence = fv.NO_RULE
    best = F.col("_best")
    found = best["score"] > 0
    return scored.withColumns(
        {
            "rule_intent": F.when(found, best["label"]).otherwise(intent),
            "rule_confidence": F.when(found, best["score"]).otherwise(F.lit(confidence)),
        }
    ).drop("_best")


def with_arbitration(rows: DataFrame) -> DataFrame:
    """Add ``intent`` and ``intent_confidence``: sure rules, sure replies, rules again.

    Rows without reply columns, or with null ones, keep the rule's answer.
    """
    if "reply_confidence" not in rows.columns:
        return rows.withColumns(
            {"intent": F.col("rule_intent"), "intent_confidence": F.col("rule_confidence")}
        )
    take_reply = (F.col("rule_confidence") <= fv.RULE_ACCEPT) & (
        F.coalesce("reply_confidence", F.lit(0.0)) > fv.REPLY_ACCEPT
    )
    return rows.withColumns(
        {
            "intent": F.when(take_reply, F.col("reply_intent")).otherwise(F.col("rule_intent")),
            "intent_confidence": F.when(take_reply, F.col("reply_confidence")).otherwise(
                F.col("rule_confidence")
            ),
        }
    )


def target_agent(fmt: Column) -> Column:
    return F.coalesce(names.lookup(F.upper(fmt), fv.AGENT_BY_FORMAT), F.lit(fv.DEFAULT_AGENT))


def reroute(fmt: Column, mime: Column) -> Column:
    """Plain-text documents go to mail or pages according to their MIME type."""
    text = F.lower(fmt) == "text"
    return (
        F.when(text & (mime == "application/pdf"), "pdf")
        .when(text & (mime == "text/plain"), "email")
        .otherwise(F.lower(fmt))
    )


VERDICT = ["_valid", "_format", "rule_intent", "rule_confidence", "content_preview"]


def with_verdict(
    docs: DataFrame, text: str = "text", name: str | None = None, known: str | None = None
) -> DataFrame:
    """Add the columns of :data:`VERDICT` to the documents."""
    body = F.col(text)
    ruled = with_rule_intent(docs.withColumn("_lower", lowered(body)), "_lower")
    return (
        with_format(ruled, text, "_lower", name, known)
        .withColumns({"_valid": is_valid_input(body), "content_preview": preview(body)})
        .drop("_lower")
    )


def classify(
    docs: DataFrame,
    replies: DataFrame | None = None,
    key: str = "doc_id",
    text: str = "text",
    name: str | None = None,
    known: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """One verdict row per document: format, intent, agent, confidence, preview.

    ``replies`` is a table ``(key, response)``; ``keep`` names further columns
    to carry along.
    """
    kept = [c for c in (keep or []) if c != key]
    rows = with_verdict(docs, text, name, known).select(key, *kept, *VERDICT)
    if replies is not None:
        parsed = one_reply_each(replies, key).withColumns(intent_reply("response"))
        rows = rows.join(parsed.drop("response"), key, "left")
    valid = F.col("_valid")
    return with_arbitration(rows).select(
        key,
        *kept,
        valid.alias("success"),
        F.when(valid, F.lower("_format")).otherwise("unknown").alias("format"),
        F.when(valid, F.col("intent")).otherwise("unknown").alias("intent"),
        F.when(valid, target_agent(F.col("_format")))
        .otherwise(fv.DEFAULT_AGENT)
        .alias("target_agent"),
        F.when(valid, F.col("intent_confidence"))
        .otherwise(F.lit(0.0))
        .alias("confidence_score"),
        "content_preview",
        F.when(~valid, F.lit(INVALID_INPUT)).alias("error"),
    )
