"""Page texts: assembly, statistics, document type, fields, scores, records.

Input is a table of page texts ``(doc_id, page, text)``; decoding of binary
page formats happens before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intakeloom import fixed_values as fv
from intakeloom.functions.jsontext import fields as variant_fields
from intakeloom.functions.keywords import best_label
from intakeloom.functions.stages import computed_once
from intakeloom.functions.text import (
    all_matches,
    count_matches,
    has,
    has_any,
    line_count,
    lowered,
    null_if_empty,
    quick,
    regex,
    strip,
    word_count,
)
from intakeloom.operators.replies import one_reply_each, with_page_reply

# What a phone number can start with.
PHONE_START = r"+(\d"
# Pages that are put together in the first of two steps; no bearing on results.
PAGES_PER_BLOCK = 256
TOO_LARGE = "Page text too large"
# Bytes a string column can hold.
LARGEST_TEXT = 2**31 - 2**20


# -------------------------------------------------------------------- assembly


def assemble(
    pages: DataFrame,
    key: str = "doc_id",
    page: str = "page",
    text: str = "text",
    pages_per_block: int = PAGES_PER_BLOCK,
    largest: int = LARGEST_TEXT,
) -> DataFrame:
    """Page texts joined in page order, each under a ``--- Page N ---`` line: one row per document.

    Pages meet in blocks first and the blocks in documents, so a large document's
    pages are put together by many tasks.  Documents with no text at all keep a
    row with null text.  A text beyond what a string can hold is null as well and
    ``too_large`` is true; its pages are never gathered.
    """
    number = F.col(page)
    block = F.floor((number - 1) / pages_per_block)
    marked = F.when(
        F.length(text) > 0,
        F.struct(
            number.alias("page"),
            F.concat(F.lit("--- Page "), number.cast("string"), F.lit(" ---\n"), F.col(text)).alias(
                "text"
            ),
        ),
    )
    blocks = (
        pages.select(key, block.alias("_block"), marked.alias("marked"))
        .groupBy(key, "_block")
        .agg(F.count("*").alias("pages"), F.collect_list("marked").alias("_pages"))
        .select(
            key,
            "_block",
            "pages",
            null_if_empty(
                F.array_join(F.transform(F.sort_array("_pages"), lambda p: p["text"]), "\n")
            ).alias("_text"),
        )
        .withColumn(
            "_bytes", F.sum(F.octet_length("_text").cast("bigint") + 1).over(Window.partitionBy(key))
        )
    )
    fits = F.coalesce(F.col("_bytes"), F.lit(0)) <= largest
    whole = F.struct("_block", F.col("_text").alias("text"))
    return (
        blocks.groupBy(key)
        .agg(
            F.sum("pages").alias("page_count"),
            F.collect_list(F.when(fits & F.col("_text").isNotNull(), whole)).alias("_blocks"),
            F.max(~fits).alias("too_large"),
        )
        .select(
            key,
            "page_count",
            "too_large",
            null_if_empty(
                F.array_join(F.transform(F.sort_array("_blocks"), lambda b: b["text"]), "\n")
            ).alias("text"),
        )
    )


def table_shapes(pages: DataFrame, keys: list[str], tables: str = "tables") -> DataFrame:
    """One row per non-empty table of a page: index, rows, columns of the first row."""
    return (
        pages.select(*keys, F.posexplode(tables).alias("table_index", "data"))
        .filter(F.size("data") > 0)
        .select(
            *keys,
            "table_index",
            F.size("data").alias("rows"),
            F.coalesce(F.size(F.get("data", F.lit(0))), F.lit(0)).alias("columns"),
            "data",
        )
    )


# ------------------------------------------------------------------ statistics


def _entity_tests(text: Column) -> dict[str, tuple[str, Column | None, bool]]:
    return {
        "emails": (fv.EMAIL_ADDRESS, has(text, "@"), True),
        "phones": (quick(fv.PAGE_PHONE, PHONE_START), None, False),
        "dates": (quick(f"(?:{fv.PAGE_DATE})", r"\d"), has(text, "/") | has(text, "-"), False),
        "currencies": (fv.PAGE_CURRENCY, has(text, "$"), False),
    }


STATISTICS = [
    "total_characters",
    "total_words",
    "total_lines",
    "average_line_length",
    "emails_found",
    "phones_found",
    "dates_found",
    "currencies_found",
]


def with_text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns of :data:`STATISTICS`; all null when there is no text."""
    sized = docs.withColumn("_text", F.when(F.length(text) > 0, F.col(text)))
    body = F.col("_text")
    counts = {
        f"{name}_found": count_matches(body, pattern, guard, ignore_case=fold)
        for name, (pattern, guard, fold) in _entity_tests(body).items()
    }
    counted = sized.withColumns(
        {
            "total_characters": F.length(body),
            "total_words": word_count(body),
            "total_lines": line_count(body),
            **counts,
        }
    ).drop("_text")
    lines = F.col("total_lines")
    return counted.withColumn(
        "average_line_length", (F.col("total_characters") - lines + F.lit(1)) / lines
    )


def first_entities(text: Column, limit: int = 5, phone_group: int = 0) -> Column:
    """The first few entities of each kind, repeats included."""
    samples = []
    for name, (pattern, guard, fold) in _entity_tests(text).items():
        group = phone_group if name == "phones" else 0
        found = all_matches(text, pattern, group, guard, ignore_case=fold)
        samples.append(F.slice(found, 1, limit).alias(f"detected_{name}"))
    return F.when(F.length(text) > 0, F.struct(*samples))


# --------------------------------------------------------------- document type


def with_document_type(
    docs: DataFrame, text: str = "text", lower_text: str = "_lower"
) -> DataFrame:
    """Add ``document_type``: most keyword hits, ``general`` for none, ``unknown`` without text."""
    scored = computed_once(
        docs, "_best", best_label(F.col(lower_text), fv.DOCUMENT_TYPE_WORDS, share=False)
    )
    best = F.col("_best")
    return scored.withColumn(
        "document_type",
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "unknown")
        .when(best["score"] > 0, best["label"])
        .otherwise("general"),
    ).drop("_best")


# ---------------------------------------------------------------------- fields


def _first_group(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, '' when there is none."""
    return F.regexp_extract(text, f"(?Udim){quick(pattern)}", 1)


def _cleaned(raw: Column) -> Column:
    """A raw match stripped; a blank first match counts as none."""
    return F.nullif(strip(raw), F.lit(""))


def _rest_of_line(raw: Column, limit: int | None = None) -> Column:
    """A raw match stripped and cut: '' when it was blank, null when nothing matched."""
    found = strip(F.nullif(raw, F.lit("")))
    return F.left(found, F.lit(limit)) if limit else found


def _filled(found: Column, limit: int) -> Column:
    """The first few elements, null when there is none."""
    return F.when(F.size(found) > 0, F.slice(found, 1, limit))


def raw_matches(kind: str, text: Column, lower_text: Column) -> dict[str, Column]:
    """What the text of one document type is searched for."""
    raw = {name: _first_group(text, p) for name, p in fv.PAGE_FIELDS[kind].items()}
    if kind == "invoice":
        # only texts with a price at all are cut into lines
        lines = F.filter(
            F.split(text, "\n"),
            lambda line: F.rlike(line, regex(fv.ITEM_LINE_PRICE))
            & has_any(F.lower(line), fv.ITEM_LINE_WORDS),
        )
        raw["line_items"] = F.when(F.rlike(text, regex(fv.ITEM_LINE_PRICE)), lines)
        raw["tax_amount"] = _first_group(text, fv.INVOICE_TAX)
    elif kind == "complaint":
        status = None
        for word in fv.COMPLAINT_STATUS_WORDS:
            test = has(lower_text, word)
            status = F.when(test, word) if status is None else status.when(test, word)
        raw["description"] = _first_group(text, fv.COMPLAINT_DESCRIPTION)
        raw["status"] = status
    elif kind == "rfq":
        raw["requirements"] = _first_group(text, fv.RFQ_REQUIREMENTS)
        raw["delivery_terms"] = _first_group(text, fv.RFQ_DELIVERY)
    return raw


def clean_match(name: str, raw: Column) -> Column:
    """The field a raw match stands for."""
    if name == "line_items":
        return F.transform(_filled(raw, 10), lambda line: strip(line))
    if name in ("description", "requirements"):
        return _rest_of_line(raw, fv.FIELD_CHARS)
    if name == "delivery_terms":
        return _rest_of_line(raw)
    if name in ("tax_amount", "status"):
        return F.nullif(raw, F.lit(""))
    return _cleaned(raw)


def raw_common(text: Column, phone_group: int = 0) -> dict[str, Column]:
    return {
        "emails": all_matches(text, fv.EMAIL_ADDRESS, only_if=has(text, "@")),
        "phone_numbers": all_matches(text, quick(fv.PAGE_PHONE, PHONE_START), phone_group),
        "addresses": all_matches(text, quick(fv.STREET_ADDRESS, r"\d")),
        "companies": all_matches(text, quick(fv.COMPANY_NAME), 1, ignore_case=True),
    }


def clean_common(name: str, raw: Column) -> Column:
    """Five distinct addresses or phones, three street addresses or companies."""
    if name in ("emails", "phone_numbers"):
        return _filled(F.array_distinct(raw), 5)
    some = _filled(raw, 3)
    return F.transform(some, lambda c: strip(c)) if name == "companies" else some


def with_common_fields(docs: DataFrame, text: str = "text", phone_group: int = 0) -> DataFrame:
    """Add the four fields all types share."""
    raw = raw_common(F.col(text), phone_group)
    found = docs.withColumns({f"_raw_{name}": value for name, value in raw.items()})
    return found.withColumns(
        {name: clean_common(name, F.col(f"_raw_{name}")) for name in raw}
    ).drop(*[f"_raw_{name}" for name in raw])


def with_fields(
    docs: DataFrame, text: str = "text", lower_text: str = "_lower", kind: str = "document_type"
) -> DataFrame:
    """Add one struct column per document type and one for the fields types share.

    Only the struct of a document's own type is filled.  Types without patterns
    (contract, general, unknown) get no fields at all, not even shared ones.
    Matches are taken in one stage and cleaned in the next, so that each
    pattern runs once.
    """
    raw: dict[str, Column] = {}
    cleaned: dict[str, Column] = {}
    for name in fv.PAGE_FIELDS:
        mine = F.col(kind) == name
        matches = raw_matches(name, F.col(text), F.col(lower_text))
        raw |= {f"_{name}_{field}": F.when(mine, value) for field, value in matches.items()}
        fields = [clean_match(f, F.col(f"_{name}_{f}")).alias(f) for f in matches]
        cleaned[f"{name}_fields"] = F.when(mine, F.struct(*fields))
    some_kind = F.col(kind).isin(list(fv.PAGE_FIELDS))
    shared = raw_common(F.col(text))
    raw |= {f"_all_{field}": F.when(some_kind, value) for field, value in shared.items()}
    fields = [clean_common(f, F.col(f"_all_{f}")).alias(f) for f in shared]
    cleaned["common_fields"] = F.when(some_kind, F.struct(*fields))
    return docs.withColumns(raw).withColumns(cleaned).drop(*raw)


def field_map() -> Column:
    """All filled fields as one ``map<string, variant>``."""

    def entries(struct: str) -> Column:
        return variant_fields(F.to_variant_object(F.col(struct)))

    empty = F.create_map().cast("map<string,variant>")
    own = F.coalesce(*[entries(f"{name}_fields") for name in fv.PAGE_FIELDS], empty)
    both = F.map_concat(own, F.coalesce(entries("common_fields"), empty))
    # null struct fields turn into JSON null: those were not found
    return F.map_filter(both, lambda _, v: ~F.is_variant_null(v))


# ---------------------------------------------------------------------- scores


def recommendations(
    page_count: Column, words: Column, kind: Column, fields: Column, tables: Column
) -> Column:
    found = F.array_compact(
        F.array(
            F.when(page_count > 20, F.lit(fv.PAGES_MANY)),
            F.when(F.coalesce(words, F.lit(0)) < 50, F.lit(fv.PAGES_FEW_WORDS)),
            F.when(F.size(fields) < 3, F.lit(fv.PAGES_FEW_FIELDS)),
            F.when(
                (kind == "invoice") & ~F.map_contains_key(fields, F.lit("amount")),
                F.lit(fv.PAGES_NO_AMOUNT),
            ),
            F.when(
                (kind == "complaint") & ~F.map_contains_key(fields, F.lit("description")),
                F.lit(fv.PAGES_NO_DESCRIPTION),
            ),
            F.when(tables, F.lit(fv.PAGES_TABLES)),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(fv.PAGES_DONE)))


def confidence(
    words: Column, fields: Column, kind: Column, reply_ok: Column, tables: Column
) -> Column:
    def bonus(test: Column, value: float) -> Column:
        return F.when(test, F.lit(value)).otherwise(F.lit(0.0))

    score = F.lit(0.5) + bonus(words > 100, 0.2)
    score = score + F.least(F.lit(0.2), F.size(fields) * F.lit(0.05))
    score = score + bonus(kind != "unknown", 0.1)
    score = score + bonus(reply_ok, 0.1)
    score = score + bonus(tables, 0.1)
    return F.least(F.lit(1.0), score)


# ------------------------------------------------------------------ full record


FACTS = [*STATISTICS, "document_type", "page_fields"]


def page_facts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Statistics, type and fields of each page text; the text itself is dropped."""
    typed = with_document_type(docs.withColumn("_lower", lowered(F.col(text))), text)
    typed = with_text_statistics(typed, text)
    found = computed_once(with_fields(typed, text), "page_fields", field_map())
    return found.drop(
        text, "_lower", "common_fields", *[f"{name}_fields" for name in fv.PAGE_FIELDS]
    )


def with_reply(
    facts: DataFrame, response: Column, page_count: Column, tables: Column
) -> DataFrame:
    """Complete page facts with a model reply (null for none) and score them."""
    kind = F.col("document_type")
    words = F.col("total_words")
    # no text, no prompt, no reply
    replied = with_page_reply(
        facts.withColumn("_asked", F.when(kind != "unknown", response)), F.col("_asked")
    )
    given, found = F.col("reply_fields"), F.col("page_fields")
    merged = F.map_concat(
        F.map_filter(found, lambda k, _: ~F.map_contains_key(given, k)), given
    )
    every = F.col("_all")
    return (
        replied.withColumn("_all", F.when(given.isNull(), found).otherwise(merged))
        .withColumns(
            {
                "field_count": F.size(every),
                "extracted_fields": F.to_json(every),
                "recommendations": recommendations(page_count, words, kind, every, tables),
                "confidence_score": confidence(words, every, kind, F.col("reply_ok"), tables),
                "success": F.lit(True),
                "error": F.when(kind == "unknown", F.lit("No page text")),
            }
        )
        .drop("page_fields", "_all", "_asked", "reply_fields", "reply_ok")
    )


def extract_pages(
    docs: DataFrame,
    replies: DataFrame | None = None,
    key: str = "doc_id",
    text: str = "text",
    page_count: str | None = "page_count",
    has_tables: str | None = None,
) -> DataFrame:
    """The full extraction row of each assembled page text.

    Facts are computed first and the text is dropped, so the join with the
    replies moves only what was found.  Documents that :func:`assemble` marked
    ``too_large`` end as errors, whatever a reply says.
    """
    facts = page_facts(docs, text)
    pages = F.col(page_count) if page_count else F.lit(0)
    tables = F.col(has_tables) if has_tables else F.lit(False)
    if replies is None:
        return _sized(with_reply(facts, F.lit(None).cast("string"), pages, tables))
    joined = facts.join(one_reply_each(replies, key), key, "left")
    return _sized(with_reply(joined, F.col("response"), pages, tables).drop("response"))


def _sized(results: DataFrame) -> DataFrame:
    """Error rows for documents whose text was too large to be put together."""
    if "too_large" not in results.columns:
        return results
    large = F.coalesce("too_large", F.lit(False))
    return results.withColumns(
        {
            "success": ~large,
            "confidence_score": F.when(large, 0.0).otherwise(F.col("confidence_score")),
            "extracted_fields": F.when(large, "{}").otherwise(F.col("extracted_fields")),
            "recommendations": F.when(~large, F.col("recommendations")),
            "error": F.when(large, TOO_LARGE).otherwise(F.col("error")),
        }
    )
