"""Document fingerprints from closed syncmers.

A window of ``k`` signs is an anchor if the least of its inner windows of ``s``
signs (by hash) is the first or the last one.  Whether a window is an anchor
depends on the window alone, so texts that share a passage share its anchors.
A fingerprint holds, for one or two scales of (k, s), the least ``ANCHORS`` anchor hashes
with the place where each occurs first.  Likeness is the estimated share of
common anchors, where only matches that come in the same order in both count.

* The coarse scale serves texts of 100 and more signs, the fine one those of 8
  to 400, the finest those of up to 32; two fingerprints are compared at the
  coarsest scale both have.
* A text shorter than the finest window is one anchor, an empty or null text
  has none.  Two texts without anchors are alike (1), one without and one with
  anchors are not (0).  Equal texts have equal fingerprints, repeated rows too.
* ``beside_next`` takes rows by id (null first), then by hash of the text.  The
  last row is followed by the first, a single row by itself.

The order is made by ranges of ids: a text moves once, compressed, and the first
row of each range also goes to the range before it.  Rows of a range stream
through its task, which holds two of them at a time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intakeloom.llm.shared import written

ANCHORS = 64
COARSE, FINE, TINY = (16, 6), (6, 2), (2, 1)  # (k, s)
COARSE_FROM, FINE_FROM, FINE_UP_TO, TINY_UP_TO = 100, 8, 400, 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(29)

Scale = tuple[np.ndarray, np.ndarray]  # anchor hashes ascending, first places
Print = dict[str, Scale]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> _SHIFT)) * _MIX
    return values ^ (values >> _SHIFT)


def _windows(signs: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Polynomial hashes of all windows of each length, put together from halves."""
    known: dict[int, tuple[np.ndarray, np.uint64]] = {1: (signs, _BASE)}

    def of(length: int) -> tuple[np.ndarray, np.uint64]:
        if length not in known:
            half = 1 << (length - 1).bit_length() - 1
            left, _ = of(half)
            right, power = of(length - half)
            n = len(signs) - length + 1
            _, left_power = known[half]
            known[length] = (left[:n] * power + right[half : half + n], left_power * power)
        return known[length]

    return [of(length)[0] for length in lengths]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchors(signs: np.ndarray, k: int, s: int) -> Scale:
    """Hashes and places of the closed syncmers of a text."""
    if len(signs) < k:
        if not len(signs):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        whole = _windows(signs, (len(signs),))[0]
        return (_mixed(whole) >> np.uint64(32)).astype(np.uint32), np.zeros(1, np.int64)
    inner, outer = _windows(signs, (s, k))
    inner = _mixed(inner)
    width = k - s + 1
    least = _least(inner, width)
    n = len(least)
    places = np.flatnonzero((inner[:n] == least) | (inner[width - 1 : width - 1 + n] == least))
    hashes = (_mixed(outer[places]) >> np.uint64(32)).astype(np.uint32)
    found, first = np.unique(hashes, return_index=True)
    return found[:ANCHORS], places[first[:ANCHORS]]


def print_of(text: str) -> Print:
    with np.errstate(over="ignore"):
        signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        out: Print = {}
        if len(signs) >= COARSE_FROM:
            out["c"] = anchors(signs, *COARSE)
        if FINE_FROM <= len(signs) <= FINE_UP_TO:
            out["f"] = anchors(signs, *FINE)
        if len(signs) <= TINY_UP_TO:
            out["t"] = anchors(signs, *TINY)
        return out


def written_out(found: Print) -> str:
    """A fingerprint as text: scale, then hash@place of each anchor."""
    return "|".join(
        f"{scale}:" + ",".join(f"{h:08x}@{p:x}" for h, p in zip(hashes.tolist(), places.tolist()))
        for scale, (hashes, places) in found.items()
    )


def read_back(text: str) -> Print:
    out: Print = {}
    for part in text.split("|"):
        scale, _, rest = part.partition(":")
        pairs = [pair.split("@") for pair in rest.split(",") if pair]
        out[scale] = (
            np.array([int(h, 16) for h, _ in pairs], np.uint32),
            np.array([int(p, 16) for _, p in pairs], np.int64),
        )
    return out


def likeness(one: Print, other: Print) -> float:
    """Share of common anchors (0 to 1) among the least hashes of both, matched in order."""
    shared = [scale for scale in ("c", "f", "t") if scale in one and scale in other]
    if not shared:
        return 0.0
    (a, a_places), (b, b_places) = one[shared[0]], other[shared[0]]
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    every = np.union1d(a, b)
    # Both sketches are complete up to the smaller of their last hashes, if cut off at all.
    if len(a) >= ANCHORS or len(b) >= ANCHORS:
        every = every[:ANCHORS]
    common, in_a, in_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    seen = common <= every[-1]
    if not seen.any():
        return 0.0
    in_order = b_places[in_b[seen]][np.argsort(a_places[in_a[seen]], kind="stable")]
    chain: list[int] = []
    for place in in_order.tolist():
        at = bisect_left(chain, place)
        chain[at : at + 1] = [place]
    return len(chain) / len(every)


def fingerprinted(documents: DataFrame, text_col: str = "text", print_col: str = "fingerprint") -> DataFrame:
    """``documents`` with the fingerprint of every whole text."""
    kept = documents.drop(print_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(print_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [written_out(print_of(text or "")) for text in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, print_col]
            )

    return kept.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by the beginning of another."""
    moved = len(text) // 4
    return text[: len(text) - moved] + following[:moved]


_DEALT = "bucket int, tail int, doc_id bigint, spot bigint, packed binary"
_BESIDE = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def beside_next(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document."""
    spark = documents.sparkSession
    rows = documents.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("spot", F.xxhash64("text"))
    keys = written(rows.select("doc_id", "spot"), "syncmer-keys")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = keys.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.2 / ranges)
    cuts = np.unique(np.array(cuts, np.float64))

    def range_of(ids: pa.Array) -> np.ndarray:
        numbers = ids.to_numpy(zero_copy_only=False).astype(np.float64)
        return np.where(np.isnan(numbers), 0, np.searchsorted(cuts, numbers, side="right")).astype(np.int32)

    def in_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range_of(batch.column(0))), *batch.columns], names=["bucket", "doc_id", "spot"]
            )

    # One row for each range: not more than there are shuffle partitions.
    firsts = [
        (row.bucket, row.first.doc_id, row.first.spot)
        for row in keys.mapInArrow(in_ranges, "bucket int, doc_id bigint, spot bigint")
        .groupBy("bucket")
        .agg(F.min(F.struct("doc_id", "spot")).alias("first"))
        .orderBy("bucket")
        .collect()
    ]
    before = {
        (doc_id, spot): firsts[k - 1][0] for k, (_, doc_id, spot) in enumerate(firsts)
    }  # the range that ends where this row begins; the first row follows the last range

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            buckets = range_of(batch.column(0)).tolist()
            ids, texts, spots = (batch.column(k).to_pylist() for k in range(3))
            out: list[tuple] = []
            for bucket, doc_id, text, spot in zip(buckets, ids, texts, spots):
                packed = pack(text.encode("utf-8", "surrogatepass"))
                out.append((bucket, 0, doc_id, spot, packed))
                if (doc_id, spot) in before:
                    out.append((before[doc_id, spot], 1, doc_id, spot, packed))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(list(column), kind) for column, kind in zip(zip(*out), kinds)]
            if out:
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "tail", "doc_id", "spot", "packed"])

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held: tuple[int, int, str, Print] | None = None
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(k).to_pylist() for k in range(5))
            for bucket, tail, doc_id, _, packed in zip(*columns):
                if tail and (held is None or held[0] != bucket):
                    continue  # the row before has met it already
                text = unpack(packed).decode("utf-8", "surrogatepass")
                found = print_of(text)
                if held is not None and held[0] == bucket:
                    changed = edited(held[2], text)
                    after = print_of(changed)
                    out.append(
                        (
                            held[1],
                            len(held[2]),
                            hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                            written_out(held[3]),
                            written_out(after),
                            likeness(held[3], after),
                            likeness(held[3], found),
                        )
                    )
                held = None if tail else (bucket, doc_id, text, found)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(column), kind) for column, kind in zip(zip(*out), kinds)], names=names
                )

    return (
        rows.select("doc_id", "text", "spot")
        .mapInArrow(deal, _DEALT)
        .repartition(ranges, "bucket")
        .sortWithinPartitions("bucket", "tail", "doc_id", "spot")
        .mapInArrow(beside, _BESIDE)
    )
