"""Text expressions shared by all extractors.

Patterns are compiled with Unicode classes and ``\\n`` as the only line end, so
``\\b``, ``\\d``, ``\\s`` and ``$`` mean the same on every Java version and the
same as in the rules they come from.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from intakeloom import fixed_values as fv

WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def regex(pattern: str, ignore_case: bool = False, multiline: bool = False) -> Column:
    flags = "Ud" + ("i" if ignore_case else "") + ("m" if multiline else "")
    return F.lit(f"(?{flags}){pattern}")


_WORD_CHOICE = re.compile(r"^\(\?:((?:[a-z][^()]*\|)*[a-z][^()]*)\)")


def quick(pattern: str, first: str | None = None) -> str:
    """The pattern behind a look-ahead for the characters a match can start with.

    It changes no match; most positions of a text fail on one character test
    instead of on every alternative.  For a pattern that opens with a choice of
    words the characters are the words' first letters.
    """
    if first is None:
        words = _WORD_CHOICE.match(pattern)
        if not words:
            return pattern
        first = "".join(sorted({word[0] for word in words.group(1).split("|")}))
    return f"(?=[{first}]){pattern}"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body uses it.

    Inside a conditional branch Spark does not share repeated subexpressions,
    so a costly value tested and then returned would be computed twice.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def null_if_empty(text: Column) -> Column:
    """The text, null when empty; the text is computed once."""
    return F.get(F.filter(F.array(text), lambda t: t != ""), F.lit(0))


def first_match(text: Column, pattern: str, group: int = 0, **flags: bool) -> Column:
    """The wanted group of the first match; null when there is no match or it is empty."""
    return null_if_empty(F.regexp_extract(text, _sql_pattern(pattern, **flags), group))


def _sql_pattern(pattern: str, **flags: bool) -> str:
    # regexp_extract takes the pattern as a plain string
    i, m = flags.get("ignore_case", False), flags.get("multiline", False)
    return f"(?Ud{'i' if i else ''}{'m' if m else ''}){pattern}"


def all_matches(
    text: Column, pattern: str, group: int = 0, only_if: Column | None = None, **flags: bool
) -> Column:
    """All matches in order of appearance.

    ``only_if`` is a cheap test that must hold for any match to exist; texts
    that fail it skip the regular expression.
    """
    found = F.regexp_extract_all(text, regex(pattern, **flags), F.lit(group))
    if only_if is None:
        return found
    return F.when(only_if, found).when(text.isNotNull(), no_strings())


def no_strings() -> Column:
    return F.array().cast("array<string>")


def count_matches(
    text: Column, pattern: str, only_if: Column | None = None, **flags: bool
) -> Column:
    counted = F.regexp_count(text, regex(pattern, **flags))
    if only_if is None:
        return counted
    return F.when(only_if, counted).when(text.isNotNull(), F.lit(0))


def has_match(text: Column, pattern: str, **flags: bool) -> Column:
    return F.rlike(text, regex(pattern, **flags))


def has(text: Column, word: str) -> Column:
    return F.contains(text, F.lit(word))


def has_any(text: Column, words: list[str]) -> Column:
    test = has(text, words[0])
    for word in words[1:]:
        test = test | has(text, word)
    return test


def lowered(text: Column) -> Column:
    """Lower-cased text, '' for null: a value that is never null keeps the many
    word tests over it free of null checks."""
    return F.coalesce(F.lower(text), F.lit(""))


def first_word_set(text: Column, word_sets: dict[str, list[str]]) -> Column:
    """Label of the first word set with a word that occurs in the text, else null."""
    result = None
    for label, words in word_sets.items():
        test = has_any(text, words)
        result = F.when(test, label) if result is None else result.when(test, label)
    return result


def word_count(text: Column) -> Column:
    return F.regexp_count(text, regex(r"\S+"))


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.lit(1)


def preview(text: Column, size: int = fv.PREVIEW_CHARS) -> Column:
    """The text itself when short, else its first ``size`` characters and dots."""
    return F.when(F.length(text) <= size, text).otherwise(
        F.concat(F.substring(text, 1, size), F.lit("..."))
    )


def sanitize(text: Column, max_length: int | None = None) -> Column:
    """Single spaces, no blank edges, optionally cut with dots; null becomes ''."""
    flat = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), _sql_pattern(r"\s+"), " ")
    if not max_length:
        return flat
    return F.when(
        F.length(flat) > max_length,
        F.concat(F.rtrim(F.substring(flat, 1, max_length)), F.lit("...")),
    ).otherwise(flat)


def text_encoding(content: Column) -> Column:
    return F.when(F.is_valid_utf8(content.cast("string")), "utf-8").when(
        content.isNotNull(), "latin-1"
    )


def decode(content: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 when they are not; line ends become ``\\n``."""
    as_utf8 = content.cast("string")
    text = F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode(content, "ISO-8859-1"))
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(
        text
    )


def decode_lossy(content: Column) -> Column:
    """Bytes as UTF-8 without the invalid ones (a genuine U+FFFD goes too)."""
    as_utf8 = content.cast("string")
    return F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(
        F.replace(F.make_valid_utf8(as_utf8), F.lit("\ufffd"), F.lit(""))
    )


def decode_char_codes(text: Column) -> Column:
    """``72,105`` becomes ``Hi``; anything but a list of codes up to 255 stays."""
    codes = F.split(text, ",").cast("array<int>")
    small = F.rlike(
        text,
        F.lit(r"^(?:0*(?:\d{1,2}|1\d\d|2[0-4]\d|25[0-5]))(?:,0*(?:\d{1,2}|1\d\d|2[0-4]\d|25[0-5]))*$"),
    )
    return F.when(small, F.array_join(F.transform(codes, lambda c: F.chr(c)), "")).otherwise(text)
