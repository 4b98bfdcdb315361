"""File names: extension, stem, type, MIME type, stamped and hashed names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from intakeloom import fixed_values as fv

STAMP = "yyyyMMdd_HHmmss"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def tail(name: Column) -> Column:
    """The last dot and what follows, as written; '' for names that only start with dots."""
    return F.regexp_extract(name, r"[^/.][^/]*(\.[^./]*)$", 1)


def stem(name: Column) -> Column:
    return F.left(name, F.length(name) - F.length(tail(name)))


def extension(name: Column) -> Column:
    """Lower-case extension with its dot, '' when there is none."""
    found = F.lower(tail(name))
    return F.when(found == ".", "").otherwise(found)


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Look a key up in a small constant table; null when absent."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(pairs, key)


def file_type(name: Column) -> Column:
    return lookup(extension(name), fv.FILE_TYPE_BY_EXTENSION)


def mime_type(name: Column) -> Column:
    return lookup(extension(name), fv.MIME_BY_EXTENSION)


def stamped_name(name: Column, at: Column) -> Column:
    """``{stem}_{time}{ext}``."""
    return F.concat(stem(name), F.lit("_"), F.date_format(at, STAMP), tail(name))


def hashed_name(name: Column, at: Column, content: Column) -> Column:
    """``{stem}_{time}_{first 8 of the content's md5}{ext}``."""
    return F.concat(
        stem(name),
        F.lit("_"),
        F.date_format(at, STAMP),
        F.lit("_"),
        F.left(F.md5(content), F.lit(8)),
        tail(name),
    )
