"""Strict JSON parsing to VARIANT and helpers over variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intakeloom.functions.stages import computed_once
from intakeloom.functions.text import let, strip

# Characters of the longest string the parser reads.
LONGEST_STRING = 20_000_000

# Closes the frame a text is parsed in; no document ends in it.
_END = "\u241eend"


def framed(text: Column) -> Column:
    """The text parsed as the first of two array elements, the second a known mark.

    ``try_parse_json`` ignores what follows the first value; only when the
    whole text is one value is the mark the second element.
    """
    body = strip(text)
    whole = F.try_parse_json(F.concat(F.lit("["), body, F.lit(f',"{_END}"]')))
    return F.when(F.rlike(body, F.lit(r'^[\[{"\-0-9tfn]')), whole)


def is_closed(frame: Column) -> Column:
    """The framed text was exactly one JSON value, which is not copied out for it; null without a frame."""
    return (F.try_variant_get(frame, "$[1]", "string") == F.lit(_END)) & F.try_variant_get(
        frame, "$[2]", "variant"
    ).isNull()


def value_of(frame: Column) -> Column:
    """The value in a frame; null when the text was not exactly one JSON value."""
    return F.when(is_closed(frame), F.try_variant_get(frame, "$[0]", "variant"))


def parse(text: Column) -> Column:
    """The text as a VARIANT, or null unless the whole text is one JSON value."""
    return let(framed(text), value_of)


def with_parsed(rows: DataFrame, name: str, text: Column) -> DataFrame:
    """Add the parsed text as a column; the text is parsed, and the value copied out, once per row."""
    read = computed_once(rows, "_frame", framed(text))
    return computed_once(read, name, value_of(F.col("_frame"))).drop("_frame")


def beyond_parser(text: Column) -> Column:
    """A text in the brackets of an object or a list, long enough to hold a string the parser refuses."""
    return F.coalesce(
        (F.length(text) > LONGEST_STRING) & F.rlike(text, F.lit(r"(?s)\A\s*(?:\{.*\}|\[.*\])\s*\z")), F.lit(False)
    )


def is_json(text: Column) -> Column:
    """The text is one JSON value, or looks like one that is too long to be read."""
    return F.coalesce(let(framed(text), is_closed), F.lit(False)) | beyond_parser(text)


def fields(value: Column) -> Column:
    """An object as ``map<string, variant>``; null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def elements(value: Column) -> Column:
    """An array as ``array<variant>``; null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def at(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def kept(value: Column, path: str) -> Column:
    """What stands at a path, as it is; null when the key is absent, a JSON null when that stands there."""
    return F.try_variant_get(value, f"$.{path}", "variant")


def is_present(value: Column, path: str) -> Column:
    """The key exists, even when its value is JSON null."""
    return kept(value, path).isNotNull()


def has_type(value: Column, path: str, kind: str) -> Column:
    """Type test of the value at a path; null when there is no value."""
    part = F.try_variant_get(value, f"$.{path}", "variant")
    if kind == "object":
        return F.when(part.isNotNull(), fields(part).isNotNull())
    if kind == "array":
        return F.when(part.isNotNull(), elements(part).isNotNull())
    names = F.schema_of_variant(part)
    if kind == "string":
        return names == "STRING"
    return names.startswith("DECIMAL") | names.isin("BIGINT", "DOUBLE", "FLOAT")


def first_element(values: Column) -> Column:
    return F.get(values, F.lit(0))
