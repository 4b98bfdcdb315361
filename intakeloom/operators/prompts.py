"""Prompt texts as a column: the input table of a batch inference job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intakeloom import fixed_values as fv
from intakeloom.functions.text import preview
from intakeloom.operators.classify import with_verdict
from intakeloom.operators.pages import with_document_type

INTENT_ANSWER = "Answer with one intent and a confidence from 0 to 1, separated by a comma."
MAIL_ANSWER = "Answer with one JSON object with the keys: " + ", ".join(fv.MAIL_REPLY_DEFAULTS) + "."
PAGE_ANSWER = (
    "Answer with one JSON object with the keys: "
    "extracted_fields, entities, summary, quality_score, insights."
)


def intent_prompt(text: Column, fmt: Column) -> Column:
    intents = ", ".join([*fv.INTENT_PHRASES, fv.NO_RULE[0]])
    return F.concat(
        F.lit("What is the intent of this "),
        fmt,
        F.lit(f" document? Intents: {intents}.\n{INTENT_ANSWER}\n\n"),
        preview(text, fv.INTENT_PROMPT_CHARS),
    )


def mail_prompt(text: Column) -> Column:
    return F.concat(
        F.lit(f"Extract the key facts of this e-mail.\n{MAIL_ANSWER}\n\n"),
        preview(text, fv.MAIL_PROMPT_CHARS),
    )


def page_prompt(text: Column, kind: Column) -> Column:
    return F.concat(
        F.lit("Extract the key facts of this "),
        kind,
        F.lit(f" document.\n{PAGE_ANSWER}\n\n"),
        F.left(text, F.lit(fv.PAGE_PROMPT_CHARS)),
    )


def category_prompt(text: Column, categories: list[str]) -> Column:
    return F.concat(
        F.lit(f"Which category fits this text best: {', '.join(categories)}?\n\n"), text
    )


def extraction_prompt(text: Column, instruction: str) -> Column:
    """An instruction of the caller's own around the whole text."""
    return F.concat(
        F.lit(f"{instruction}\n\nText to process:\n"), text, F.lit("\n\nExtracted information:")
    )


def unsure_prompts(judged: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Prompts for judged documents the rules are not sure about, and only those."""
    unsure = judged.filter(F.col("_valid") & (F.col("rule_confidence") <= fv.RULE_ACCEPT))
    return unsure.select(key, intent_prompt(F.col(text), F.col("_format")).alias("prompt"))


def intent_prompts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", name: str | None = None
) -> DataFrame:
    return unsure_prompts(with_verdict(docs, text, name), key, text)


def page_prompts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Prompts for page texts; documents without text get none."""
    typed = with_document_type(docs.withColumn("_lower", F.lower(text)), text)
    return typed.filter("document_type != 'unknown'").select(
        key, page_prompt(F.col(text), F.col("document_type")).alias("prompt")
    )
