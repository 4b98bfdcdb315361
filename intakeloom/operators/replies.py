"""Model replies given as a table ``(key, response)``: parse, repair, default.

No model is called here; a reply table is the output of some batch inference
over the prompts of :mod:`intakeloom.operators.prompts`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intakeloom import fixed_values as fv
from intakeloom.functions import jsontext
from intakeloom.functions.text import first_word_set, has, let, null_if_empty, strip


def one_reply_each(replies: DataFrame, key: str = "doc_id") -> DataFrame:
    """One reply per key, so that a repeated reply cannot multiply documents.

    A maximum combines before the shuffle, so a key with very many replies
    reaches the reducers as one row per map task.
    """
    return replies.groupBy(key).agg(F.max("response").alias("response"))


# ------------------------------------------------------------ intent replies


# What counts as a number in a reply (Java would also take a trailing d or f).
NUMBER = r"(?i)^[+-]?(?:\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?|inf|infinity|nan)$"


def clamp(value: Column) -> Column:
    return F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0))


def intent_reply(response: str) -> dict[str, Column]:
    """``reply_intent`` and ``reply_confidence`` of a reply like ``invoice,0.85``.

    A reply without a comma, a number or a known intent is (unknown, 0.3).
    NaN becomes 0: it is not above any threshold.
    """
    parts = F.split(strip(F.col(response)), ",")
    intent = F.lower(strip(F.get(parts, F.lit(0))))
    written = strip(F.get(parts, F.lit(1)))
    number = F.when(F.rlike(written, F.lit(NUMBER)), written.try_cast("double"))
    known = intent.isin([*fv.INTENT_PHRASES, fv.NO_RULE[0]])
    usable = F.coalesce(known & number.isNotNull(), F.lit(False))
    nothing, low = fv.NO_REPLY
    return {
        "reply_intent": F.when(usable, intent).otherwise(nothing),
        "reply_confidence": F.when(
            usable, F.when(F.isnan(number), F.lit(0.0)).otherwise(clamp(number))
        ).otherwise(F.lit(low)),
    }


# ---------------------------------------------------------- category replies


def first_category(text: Column, categories: list[str]) -> Column:
    """The first listed category that occurs in the text, else null."""
    lowered = F.lower(text)
    result = None
    for category in categories:
        test = has(lowered, category.lower())
        result = F.when(test, category) if result is None else result.when(test, category)
    return result


def category_by_keyword(text: Column, categories: list[str]) -> Column:
    """``struct(category, confidence)`` from the document when a reply is useless."""
    found = first_category(text, categories)
    return F.struct(
        F.coalesce(found, F.lit(categories[0])).alias("category"),
        F.when(found.isNotNull(), F.lit(0.6)).otherwise(F.lit(0.3)).alias("confidence"),
    )


def json_part(response: Column) -> Column:
    """The JSON inside a reply: a fenced block, the whole, or the outermost braces."""
    body = strip(response)
    fenced = strip(F.regexp_extract(body, r"(?s)```json(.*?)```", 1))
    braced = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return (
        F.when(has(body, "```json"), fenced)
        .when(F.startswith(body, F.lit("{")) & F.endswith(body, F.lit("}")), body)
        .when(F.length(braced) > 0, braced)
        .otherwise(body)
    )


def category_reply(response: Column, text: Column, categories: list[str]) -> Column:
    """``struct(category, confidence)`` of a JSON reply, repaired from the text.

    A category outside the list is replaced by the first one the document
    mentions, a little less sure; unreadable replies, and replies to be repaired
    that give no reasoning, fall back to keywords.
    """
    found = first_category(text, categories)
    fallback = category_by_keyword(text, categories)

    def judged(value: Column) -> Column:
        is_object = jsontext.fields(value).isNotNull()
        named = jsontext.at(value, "category")
        stated = jsontext.at(value, "confidence", "double")
        repaired = F.greatest(F.lit(0.3), F.coalesce(stated, F.lit(0.5)) - F.lit(0.1))
        accepted = F.coalesce(named.isin(categories), F.lit(False))
        return (
            F.when(
                is_object & accepted,
                F.struct(named.alias("category"), stated.alias("confidence")),
            )
            .when(
                is_object & (found.isNull() | jsontext.is_present(value, "reasoning")),
                F.struct(
                    F.coalesce(found, F.lit(categories[0])).alias("category"),
                    F.when(found.isNotNull(), repaired).otherwise(F.lit(0.3)).alias("confidence"),
                ),
            )
            .otherwise(fallback)
        )

    return let(jsontext.parse(json_part(response)), judged)


def category_in_reply(response: Column, categories: list[str]) -> Column:
    """First category the reply mentions, else the first category; 0.8 either way."""
    return F.struct(
        F.coalesce(first_category(response, categories), F.lit(categories[0])).alias("category"),
        F.lit(0.8).alias("confidence"),
    )


def category_exact(response: Column, categories: list[str]) -> Column:
    """The reply when it is a category as it stands, else the first one; 0.7."""
    body = strip(response)
    return F.struct(
        F.when(body.isin(categories), body).otherwise(categories[0]).alias("category"),
        F.lit(0.7).alias("confidence"),
    )


# ------------------------------------------------------------- mail replies


def without_fences(response: Column) -> Column:
    """A reply without the code fence around it."""
    body = strip(response)
    body = F.regexp_replace(body, r"\A```json", "")
    body = F.regexp_replace(body, r"\A```", "")
    return strip(F.regexp_replace(body, r"```\z", ""))


def mail_hints(response: Column) -> dict[str, Column]:
    """Sentiment and sender intent read off a reply that is not JSON."""
    lowered = F.lower(response)
    return {
        "sentiment": F.coalesce(first_word_set(lowered, fv.SENTIMENT_WORDS), F.lit("neutral")),
        "sender_intent": first_word_set(lowered, fv.SENDER_INTENT_WORDS),
    }


def _default(key: str) -> Column:
    value = fv.MAIL_REPLY_DEFAULTS[key]
    if value is None:
        return F.lit(None).cast("string")
    if isinstance(value, list):
        return F.array().cast("array<string>")
    return F.lit(value)


def with_mail_reply(rows: DataFrame, response: Column) -> DataFrame:
    """Add the six reply fields and ``reply_extras`` (``map<string, variant>``).

    Missing keys get their default, a key present with null stays null.  A JSON
    reply that is no object counts as no reply; any other text is searched for
    sentiment and intent.
    """
    read = jsontext.with_parsed(rows, "_value", without_fences(response)).withColumn(
        "_entries", jsontext.fields(F.col("_value"))
    )
    value, entries = F.col("_value"), F.col("_entries")
    is_text = F.coalesce(value.isNull() & (F.length(response) > 0), F.lit(False))
    hints = mail_hints(response)
    columns = {}
    for key in fv.MAIL_REPLY_DEFAULTS:
        kind = "array<string>" if key == "key_entities" else "string"
        given = F.coalesce(F.map_contains_key(entries, F.lit(key)), F.lit(False))
        column = F.when(given, jsontext.at(value, key, kind))
        if key in hints:
            column = column.when(is_text, F.coalesce(hints[key], _default(key)))
        columns[key] = column.otherwise(_default(key))
    columns["reply_extras"] = F.map_filter(
        entries, lambda k, _: ~k.isin(list(fv.MAIL_REPLY_DEFAULTS))
    )
    return read.withColumns(columns).drop("_value", "_entries")


# ------------------------------------------------------------- page replies


def with_page_reply(rows: DataFrame, response: Column) -> DataFrame:
    """Add ``reply_fields``, ``raw_response`` and ``reply_ok`` of an extraction reply.

    ``reply_fields`` is the ``extracted_fields`` object as ``map<string,
    variant>``; text that is not JSON is kept as ``raw_response``.  A reply is
    good if it is text, or a JSON object, list or string that is not empty and
    has no ``error`` in it.
    """
    read = jsontext.with_parsed(rows, "_value", response).withColumns(
        {
            "_entries": jsontext.fields(F.col("_value")),
            "_elements": jsontext.elements(F.col("_value")),
        }
    )
    value, entries, elements = F.col("_value"), F.col("_entries"), F.col("_elements")
    said = F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))
    good = (
        F.when(value.isNull(), True)
        .when(
            entries.isNotNull(),
            (F.size(entries) > 0) & ~F.map_contains_key(entries, F.lit("error")),
        )
        .when(
            elements.isNotNull(),
            (F.size(elements) > 0)
            & ~F.exists(
                elements,
                lambda x: (F.schema_of_variant(x) == "STRING")
                & (F.try_variant_get(x, "$", "string") == "error"),
            ),
        )
        .otherwise((F.length(said) > 0) & ~has(said, "error"))
    )
    return read.withColumns(
        {
            "reply_fields": jsontext.fields(F.try_element_at(entries, F.lit("extracted_fields"))),
            "raw_response": F.when(value.isNull(), null_if_empty(response)),
            "reply_ok": response.isNotNull() & F.coalesce(good, F.lit(False)),
        }
    ).drop("_value", "_entries", "_elements")
