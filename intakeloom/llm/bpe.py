"""Byte-level BPE encoding and decoding with DuckDB inside each partition.

A text is cut into the matches of a pattern; each match ("word") is encoded on
its own.  The distinct words of a batch become rows (word, position, token), and
a recursive query joins neighbouring tokens with the merge table and contracts
the leftmost pair of least rank in every word until no pair is left.  Decoding
looks the tokens of a list up in the vocabulary and aggregates them in order.

* A word that is a token itself is that token, as in the usual encoders.
* Words of more than ``LONG`` bytes contract further occurrences of the pair in
  the same step, unless the vocabulary has an earlier token that begins or ends
  with the merged one, in which case such a token might have to come first.
* A null or empty text gives no ids, and no ids give no bytes.  Repeated rows
  are encoded each; other columns pass through, whatever their names.
* The ranks are a file of bounded size (a vocabulary), read by the driver and
  sent along with the tasks.  Memory of a task: one Arrow batch, the words of a
  slice of it, and about ``CACHE`` words met before; older ones are forgotten.
* A recursive query keeps the tokens of all its steps, so words are batched by
  the rows their steps can make, and long words are contracted a few steps at a
  time: each query goes on from where the one before ended, until nothing is
  left to contract.  What a single word makes beyond that, DuckDB spills to the
  task's own temporary folder.  Texts beyond ``SLICE`` are cut into words bit by
  bit.
"""

from __future__ import annotations

import base64
import re
import shutil
import sys
import tempfile
from collections.abc import Iterable, Iterator
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE = 300_000
LONG = 48
SLICE = 2_000_000  # characters encoded at a time
BATCH = 25_000  # words a recursive query takes at a time
HELD = 4_000_000  # rows all steps of a recursive query can make
PART = 200_000  # words of a long text taken at a time

# A token's place is its word's number times 2**32 plus its position.
_NEIGHBOURS = """
  CASE WHEN (lead(spot) OVER w) >> 32 = spot >> 32 THEN lead(spot) OVER w END AS next_spot,
  lead(id) OVER w AS next_id
"""
_RESULT = """
SELECT word, list(id ORDER BY spot) AS ids, any_value(last) AS steps
FROM tokens JOIN (SELECT spot >> 32 AS word, max(step) AS last FROM tokens GROUP BY 1)
  ON word = spot >> 32 AND step = last
GROUP BY 1
"""
SHORT_WORDS = f"""
WITH RECURSIVE tokens AS (
  SELECT 0 AS step, spot, id, {_NEIGHBOURS} FROM start WINDOW w AS (ORDER BY spot)
  UNION ALL
  (WITH best AS (
     SELECT spot >> 32 AS word, min(rank << 32 | (spot & 4294967295)) AS least
     FROM tokens JOIN merges ON pair = (id::BIGINT << 32 | next_id)
     WHERE next_spot IS NOT NULL GROUP BY 1),
   marked AS (
     SELECT t.*, (least >> 32)::INT AS rank, spot & 4294967295 = least & 4294967295 AS chosen
     FROM tokens t JOIN best b ON b.word = t.spot >> 32),
   kept AS (
     SELECT step + 1 AS step, spot, CASE WHEN chosen THEN rank ELSE id END AS id
     FROM marked ANTI JOIN (SELECT next_spot AS gone FROM marked WHERE chosen) ON gone = spot)
   SELECT step, spot, id, {_NEIGHBOURS} FROM kept WINDOW w AS (ORDER BY spot))
)
{_RESULT}
"""
LONG_WORDS = f"""
WITH RECURSIVE tokens AS (
  SELECT 0 AS step, spot, id, {_NEIGHBOURS} FROM start WINDOW w AS (ORDER BY spot)
  UNION ALL
  (WITH ranked AS (
     SELECT spot, next_spot, rank, alone FROM tokens JOIN merges ON pair = (id::BIGINT << 32 | next_id)
     WHERE next_spot IS NOT NULL AND step < $steps),
   best AS (
     SELECT spot >> 32 AS word, min(rank << 32 | (spot & 4294967295)) AS least FROM ranked GROUP BY 1),
   hits AS (
     SELECT spot, next_spot, rank, lag(next_spot) OVER (ORDER BY spot) IS DISTINCT FROM spot AS fresh
     FROM ranked JOIN best ON word = spot >> 32 AND rank = least >> 32
     WHERE NOT alone OR spot & 4294967295 = least & 4294967295),
   runs AS (SELECT *, count(*) FILTER (fresh) OVER (ORDER BY spot ROWS UNBOUNDED PRECEDING) AS run FROM hits),
   chosen AS (
     SELECT spot, next_spot, rank::INT AS rank FROM runs
     QUALIFY row_number() OVER (PARTITION BY run ORDER BY spot) % 2 = 1),
   kept AS (
     SELECT step + 1 AS step, t.spot, coalesce(c.rank, t.id) AS id
     FROM tokens t JOIN best b ON b.word = t.spot >> 32 LEFT JOIN chosen c ON c.spot = t.spot
     WHERE t.spot NOT IN (SELECT next_spot FROM chosen))
   SELECT step, spot, id, {_NEIGHBOURS} FROM kept WINDOW w AS (ORDER BY spot))
)
{_RESULT}
"""
DECODE = """
SELECT list_aggregate(list_transform(ids, lambda id: pieces[id + 1]), 'string_agg', '') AS bytes
FROM batch, vocabulary ORDER BY row
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Duck:
    """A database in memory that may spill to a folder of its own, which goes with it."""

    def __init__(self) -> None:
        self.folder = tempfile.mkdtemp()
        config = {"threads": 1, "memory_limit": "300MB", "temp_directory": self.folder}
        self.base = duckdb.connect(config=config)
        self.base.execute("SET enable_progress_bar = false")

    def close(self) -> None:
        self.base.close()
        shutil.rmtree(self.folder, ignore_errors=True)


def _batched(words: list[tuple], rows) -> Iterator[list[tuple]]:
    """Consecutive words whose steps make about ``HELD`` rows at most, one at least."""
    batch, held = [], 0
    for word in words:
        size = rows(word[1])
        if batch and (held + size > HELD or len(batch) >= BATCH):
            yield batch
            batch, held = [], 0
        batch.append(word)
        held += size
    if batch:
        yield batch


class Splitter:
    """Cuts texts into the matches of a pattern, with the quicker ``re`` where it cannot differ.

    ``re`` has no classes for letters and numbers.  ``[^\\W\\d_]`` and ``\\d`` stand
    for them in texts without number signs outside the decimal digits and
    without the separators that count as white space for ``re`` alone.
    """

    UNLIKE = regex.compile(r"[\p{No}\p{Nl}\x1c-\x1f]|(?![\p{L}\p{N}_])[\w]")
    SEPARATORS = re.compile("[\x1c-\x1f]")

    def __init__(self, pattern: str):
        self.exact = regex.compile(pattern)
        quick = (
            pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)")
            .replace(r"\p{L}", r"[^\W\d_]")
            .replace(r"\p{N}", r"\d")
        )
        self.quick = None if r"\p" in quick else re.compile(quick)
        self.known: set[str] = set()

    def __call__(self, text: str) -> list[str]:
        return self._for(text).findall(text)

    def each(self, text: str) -> Iterator[str]:
        """The same matches one after another."""
        return (found.group() for found in self._for(text).finditer(text))

    def _for(self, text: str):
        """The pattern to use for a text."""
        if self.quick is None:
            return self.exact
        if not text.isascii():
            fresh = set(text) - self.known
            if fresh:
                alike = {c for c in fresh if not self.UNLIKE.match(c) and self._same(c)}
                self.known |= alike
                if len(alike) < len(fresh):
                    return self.exact
        elif self.SEPARATORS.search(text):
            return self.exact
        return self.quick

    def _same(self, sign: str) -> bool:
        kinds = ((r"\s", r"\s"), (r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"))
        return all(bool(regex.match(a, sign)) == bool(re.match(b, sign)) for a, b in kinds)


class Encoder:
    """Encodes words in batches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = Splitter(pattern)
        self.ranks = ranks
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        pairs, merged, inverted = [], [], set()
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                inverted |= {part for part in (left, right) if part is not None and part > rank}
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    merged.append(rank)
        merges = pa.table(
            {
                "pair": pa.array(pairs, pa.int64()),
                "rank": pa.array(merged, pa.int64()),
                "alone": [rank in inverted for rank in merged],
            }
        )
        self.store = Duck()
        self.duck = self.store.base
        self.duck.register("merge_rows", merges)
        self.duck.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")

    def learn(self, words: Iterable[str]) -> None:
        """Put the ids of all words into the cache."""
        short, long = [], []
        for word in words:
            data = word.encode("utf-8")
            rank = self.ranks.get(data)
            if rank is not None:
                self.cache[word] = rank.to_bytes(4, sys.byteorder)
            else:
                (short if len(data) <= LONG else long).append((word, data))
        for some in _batched(short, lambda data: len(data) * (len(data) + 2) // 2):
            lengths = np.array([len(data) for _, data in some], np.int64)
            flat = self.bytes[np.frombuffer(b"".join(data for _, data in some), np.uint8)]
            for k, ids, _ in self._contracted(flat, lengths, SHORT_WORDS, {}):
                self.cache[some[k][0]] = ids
        open_ = [(word, self.bytes[np.frombuffer(data, np.uint8)].tobytes()) for word, data in long]
        while open_:
            left = []
            for some in _batched(open_, lambda ids: 2 * len(ids)):
                lengths = np.array([len(ids) // 4 for _, ids in some], np.int64)
                steps = max(1, HELD // int(lengths.sum()))
                flat = np.frombuffer(b"".join(ids for _, ids in some), np.int32)
                for k, ids, taken in self._contracted(flat, lengths, LONG_WORDS, {"steps": steps}):
                    if taken < steps:
                        self.cache[some[k][0]] = ids
                    else:
                        left.append((some[k][0], ids))
            open_ = left

    def _contracted(self, flat: np.ndarray, lengths: np.ndarray, sql: str, bound: dict) -> Iterator[tuple[int, bytes, int]]:
        """Number, ids after the query's steps and number of steps, of words given as ids one after another."""
        first = np.cumsum(lengths) - lengths
        number = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
        place = np.arange(len(flat), dtype=np.int64) - first[number]
        self.duck.register("start", pa.table({"spot": number << 32 | place, "id": flat}))
        found = self.duck.sql(sql, params=bound or None).to_arrow_table()
        self.duck.unregister("start")
        lists = found["ids"].combine_chunks()
        data, ends = lists.values.to_numpy().astype(np.int32, copy=False).tobytes(), lists.offsets.to_pylist()
        words, steps = found["word"].to_numpy().tolist(), found["steps"].to_numpy().tolist()
        for k, word in enumerate(words):
            yield word, data[4 * ends[k] : 4 * ends[k + 1]], steps[k]

    def _known(self, cut: list[list[str]]) -> None:
        """See to it that the cache has all these words."""
        if len(self.cache) > CACHE // 2:
            self.older, self.cache = self.cache, {}
        fresh = set().union(*cut) - self.cache.keys()
        for word in fresh & self.older.keys():
            self.cache[word] = self.older[word]
        self.learn(fresh - self.cache.keys())

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        if len(texts) == 1 and len(texts[0] or "") > SLICE:
            words, parts = self.split.each(texts[0]), []
            while part := list(islice(words, PART)):
                self._known([part])
                parts.append(b"".join(map(self.cache.__getitem__, part)))
            ids = [b"".join(parts)]
        else:
            cut = [self.split(text) if text else [] for text in texts]
            self._known(cut)
            look = self.cache.__getitem__
            ids = [b"".join(map(look, words)) for words in cut]
        ends = np.cumsum([0, *[len(x) // 4 for x in ids]])
        flat = np.frombuffer(b"".join(ids), np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


class Decoder:
    """Looks the tokens of lists up and puts their bytes together in order."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = {rank: token.decode("latin-1") for token, rank in ranks.items()}
        pieces = [by_id.get(rank, "") for rank in range(max(by_id) + 1)]
        self.store = Duck()
        self.duck = self.store.base
        self.duck.register("piece_rows", pa.table({"id": np.arange(len(pieces)), "piece": pieces}))
        self.duck.execute("CREATE TABLE vocabulary AS SELECT list(piece ORDER BY id) AS pieces FROM piece_rows")

    def decode(self, ids: pa.Array) -> pa.Array:
        out: list[bytes] = []
        for at in range(0, len(ids), 500):
            some = ids.slice(at, 500)
            self.duck.register("batch", pa.table({"row": np.arange(len(some)), "ids": some}))
            out += [(text or "").encode("latin-1") for (text,) in self.duck.sql(DECODE).fetchall()]
            self.duck.unregister("batch")
        return pa.array(out, pa.binary())


def _slices(batch: pa.RecordBatch, given: str) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``SLICE`` characters or tokens; a longer row comes alone."""
    column = batch.column(given)
    length = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
    sizes = pc.fill_null(length(column), 0).to_numpy(zero_copy_only=False)
    number = np.cumsum(sizes) // SLICE
    starts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
    for start, end in zip(starts, starts[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def _coded(
    documents: DataFrame, path: str, pattern: str | None, given: str, added: dict[str, T.DataType]
) -> DataFrame:
    """One pass over the rows; encoder and decoder are given back at the end of each task."""
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(path))
    kept = documents.drop(*added)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, kind) for c, kind in added.items()]])
    decodes = any(isinstance(kind, T.BinaryType) for kind in added.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, pattern) if pattern is not None else None
        decoder = Decoder(ranks.value) if decodes else None
        for whole in batches:
            for batch in _slices(whole, given):
                new = []
                ids = batch.column(given)
                if encoder is not None:
                    ids = encoder.encode(ids.to_pylist())
                    new.append(ids)
                if decoder is not None:
                    new.append(decoder.decode(ids))
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)
        for part in (encoder, decoder):
            if part is not None:
                part.store.close()

    return kept.mapInArrow(run, schema)


_IDS = T.ArrayType(T.IntegerType())


def encoded(
    documents: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids"
) -> DataFrame:
    """``documents`` with the ids of ``text_col``; a column ``ids_col`` of theirs is replaced."""
    return _coded(documents, path, pattern, text_col, {ids_col: _IDS})


def decoded(documents: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "bytes") -> DataFrame:
    """``documents`` with the bytes their ids stand for; an id outside the vocabulary stands for none."""
    return _coded(documents, path, None, ids_col, {bytes_col: T.BinaryType()})


def there_and_back(
    documents: DataFrame,
    path: str,
    pattern: str,
    text_col: str = "text",
    ids_col: str = "ids",
    bytes_col: str = "bytes",
) -> DataFrame:
    """Both: the ids of a text and the bytes decoded from these ids."""
    return _coded(documents, path, pattern, text_col, {ids_col: _IDS, bytes_col: T.BinaryType()})


def digests(documents: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``documents`` without the text, with number of tokens and hashes of ids and decoded bytes."""
    both = there_and_back(documents, path, pattern, text_col)
    rest = [F.col(f"`{c}`") for c in both.columns if c not in (text_col, "ids", "bytes")]
    return both.select(
        *rest,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
