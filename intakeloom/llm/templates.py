"""Line dedup with a tree of log templates.

A line is parsed down a tree of fixed depth: by its number of tokens, then by its
first ``LEADING`` tokens, where a token with a digit stands for any.  At the leaf
the rest of a line of fewer than ``FIELDS`` tokens is a template as it is; a longer
one belongs to four templates, each with one of its quarters generalised to a
variable field, and equal lines to the same four.
A template is recurring when ``min_docs`` documents or more hold it.  A line with
a recurring template is dropped everywhere but in the document of the smallest
id that holds the template.

* Lines end at line feeds; tokens are separated by ASCII white space.  Lines of
  fewer than ``MIN_TOKENS`` tokens, empty ones among them, always stay.
* Every row is a document.  Rows of one id and text are treated alike, and all
  rows of the smallest id keep the line; a null id comes after all others.
* A null text stays null and has no lines.  An empty table gives no rows.  Other
  columns pass through, whatever their names.
* A document gives each of its templates once, so counts combine before the
  shuffle; rows of templates that many documents hold are not shuffled at all.
  A document's own lines are all a task ever gathers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intakeloom.llm.shared import met, written

LEADING, FIELDS, MIN_TOKENS = 2, 8, 4
LAST_ID = 2**63 - 1
SPOTS = 2**20

_VARIABLE = re.compile(rb"\S*[0-9]\S*")


def _number(parts: list[bytes]) -> int:
    value = xxhash.xxh3_64_intdigest(b"\x00".join(parts))
    return value - (1 << 64) if value >> 63 else value


def templates(line: str) -> list[int]:
    """Numbers of the templates a line belongs to; none for a short line."""
    data = line.encode("utf-8", "surrogatepass")
    tokens = _VARIABLE.sub(b"<*>", data).split()
    if len(tokens) < MIN_TOKENS:
        return []
    path = [b"%d" % len(tokens), *tokens[:LEADING]]
    rest = tokens[LEADING:]
    if len(tokens) < FIELDS:
        return [_number([*path, b"all", *rest])]
    found = []
    for quarter in range(4):
        start, end = len(rest) * quarter // 4, len(rest) * (quarter + 1) // 4
        found.append(_number([*path, b"but %d" % quarter, *rest[:start], b"<*>", *rest[end:]]))
    return found


def places(id_col: str, text_col: str) -> tuple[Column, Column]:
    """A row's id, and a small number that parts the rows of one id by their texts."""
    row_id = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LAST_ID))
    return row_id.alias("id"), F.pmod(F.xxhash64(F.col(f"`{text_col}`")), F.lit(SPOTS)).cast("int").alias("spot")


def beside(documents: DataFrame, keys: DataFrame, place: tuple[Column, Column]) -> DataFrame:
    """(row, keys): the rows whole, as structs, so that no name clashes, and the keys (id, spot, keys) of their places."""
    rows = documents.select(*place, F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    return rows.join(keys, ["id", "spot"], "left").select("row", "keys")


def without_recurring(
    documents: DataFrame, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``documents`` with recurring lines taken out of the text, ``template_lines`` and ``template_dropped``."""
    kept = documents.drop("template_lines", "template_dropped")
    place = places(id_col, text_col)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                list({key for line in (text or "").split("\n") for key in templates(line)})
                for text in batch.column(2).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["id", "spot", "keys"]
            )

    held = written(
        documents.select(*place, F.col(f"`{text_col}`").alias("text")).mapInArrow(
            keys, "id bigint, spot int, keys array<bigint>"
        ),
        "template-keys",
    ).select("id", "spot", F.explode("keys").alias("key"))
    recurring = (
        held.groupBy("key")
        .agg(F.count("*").alias("rows"), F.min("id").alias("first"))
        .where(F.col("rows") >= min_docs)
    )
    drops = (
        met(held, recurring, "template-recurring")
        .where("id > first")
        .groupBy("id", "spot")
        .agg(F.collect_set("key").alias("keys"))
    )
    joined = beside(kept, drops, place)
    counts = [T.StructField(c, T.LongType()) for c in ("template_lines", "template_dropped")]
    schema = T.StructType([*kept.schema.fields, *counts])
    at = kept.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            columns = batch.column(0).flatten()
            for text, drop in zip(columns[at].to_pylist(), batch.column(1).to_pylist()):
                whole = [] if text is None else text.split("\n")
                stay = whole
                if drop:
                    gone = set(drop)
                    stay = [line for line in whole if gone.isdisjoint(templates(line))]
                texts.append(text if text is None or len(stay) == len(whole) else "\n".join(stay))
                lines.append(len(whole))
                dropped.append(len(whole) - len(stay))
            columns[at] = pa.array(texts, pa.string())
            columns += [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(clean, schema)
