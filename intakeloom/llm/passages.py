"""Passages that repeat across documents: exact runs of ``RUN`` tokens, wherever they stand.

Every run of ``RUN`` tokens that documents of different ids hold is cut out of all
but the documents of the smallest id that hold it.  Runs may begin and end within
lines and reach across them.  To find them without a key for each token, the
hashes of ``GRAM`` tokens are winnowed first: of every ``RUN`` tokens the least
hash is kept, so a common run has a common kept hash.  Whole runs are then
compared only around hashes that several documents keep.

* Tokens are separated by ASCII white space; a run is its tokens, whatever is
  between them.  White space around what is cut stays.  Runs that only come about
  by a cut are not looked for.
* Every row is a document.  Rows of one id and text are treated alike; a null id
  comes after all others.  A null text stays null.  Other columns pass through.
* A document gives each hash once, so counts combine before the shuffle; rows of
  hashes that many documents hold are not shuffled at all.  A document's own
  hashes are all a task ever gathers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intakeloom.llm.shared import met, written
from intakeloom.llm.templates import beside, places

RUN, GRAM = 50, 25
_REMEMBERED = 150_000
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


class _Hashes(dict):
    def __missing__(self, token: bytes) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        found = self[token] = xxhash.xxh3_64_intdigest(token)
        return found


_hashes = _Hashes()


def _tokens(text: str | None) -> np.ndarray:
    parts = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(_hashes.__getitem__, parts), np.uint64, len(parts))


def _grams(tokens: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` tokens."""
    count = max(len(tokens) - size + 1, 0)
    total = np.zeros(count, np.uint64)
    for at in range(size if count else 0):
        total = total * np.uint64(0x9E3779B97F4A7C15) + tokens[at : at + count]
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (total ^ (total >> np.uint64(32))).view(np.int64)


def kept_hashes(text: str | None) -> np.ndarray:
    """The least hash of ``GRAM`` tokens of every ``RUN`` tokens, each once."""
    grams = _grams(_tokens(text), GRAM)
    wide = RUN - GRAM + 1
    if len(grams) < wide:
        return np.empty(0, np.int64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(grams, wide).min(1))


def runs_around(text: str | None, shared: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``RUN`` tokens that hold one of the hashes."""
    tokens = _tokens(text)
    before = np.concatenate([[0], np.cumsum(np.isin(_grams(tokens, GRAM), shared))])
    runs = _grams(tokens, RUN)
    wide = RUN - GRAM + 1
    return np.unique(runs[before[wide : wide + len(runs)] > before[: len(runs)]])


def cut(text: str, gone: np.ndarray) -> str:
    """The text without the tokens of the runs."""
    hit = np.flatnonzero(np.isin(_grams(_tokens(text), RUN), gone))
    if not len(hit):
        return text
    spans = [match.span() for match in _TOKEN.finditer(text)]
    parts, done, at = [], 0, 0
    while at < len(hit):
        last = at
        while last + 1 < len(hit) and hit[last + 1] <= hit[last] + RUN:
            last += 1
        parts.append(text[done : spans[hit[at]][0]])
        done, at = spans[hit[last] + RUN - 1][1], last + 1
    return "".join([*parts, text[done:]])


def _found(frame: DataFrame, find, columns: int, purpose: str) -> DataFrame:
    """(id, spot, key): what ``find`` makes of the last columns of (id, spot, text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(2 + k).to_pylist() for k in range(columns)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([find(*row) for row in rows], pa.list_(pa.int64()))],
                names=["id", "spot", "keys"],
            )

    found = written(frame.mapInArrow(run, "id bigint, spot int, keys array<bigint>"), purpose)
    return found.select("id", "spot", F.explode("keys").alias("key"))


def _shared(held: DataFrame, only_later: bool) -> DataFrame:
    """(id, spot, keys): of every document the keys that documents of other ids hold, or those of smaller ids."""
    several = (
        held.groupBy("key")
        .agg(F.count("*").alias("rows"), F.min("id").alias("first"), F.max("id").alias("last"))
        .where("first < last")
        .drop("last")
    )
    found = met(held, several, "passage-shared")
    return (found.where("id > first") if only_later else found).groupBy("id", "spot").agg(F.collect_set("key").alias("keys"))


def without_passages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with repeated passages cut out of the text."""
    place = places(id_col, text_col)
    texts = documents.select(*place, F.col(f"`{text_col}`").alias("text"))
    kept = _shared(_found(texts, kept_hashes, 1, "passage-hashes"), False)
    around = texts.join(kept, ["id", "spot"]).select("id", "spot", "text", "keys")
    runs = _found(around, lambda text, keys: runs_around(text, np.array(keys, np.int64)), 2, "passage-runs")
    joined = beside(documents, _shared(runs, True), place)
    names, at = documents.columns, documents.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            texts = [
                cut(text, np.array(gone, np.int64)) if gone else text
                for text, gone in zip(columns[at].to_pylist(), batch.column(1).to_pylist())
            ]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(clean, documents.schema)
