"""Hashed word features of whole texts, and labelled samples to fit on."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 18
SIZE = 1 << BITS
_MASK = SIZE - 1
_REMEMBERED = 150_000

_LETTERS = regex.compile(r"[^\p{L}]+")


def _hashed(kind: str, part: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}\x00{part}") & _MASK


class _Words(dict):
    """Feature numbers of a word, worked out once; forgotten when there are too many."""

    def __init__(self, parts: Callable[[str], list[int]]):
        super().__init__()
        self.parts = parts

    def __missing__(self, word: str) -> list[int]:
        if len(self) > _REMEMBERED:
            self.clear()
        found = self[word] = self.parts(word)
        return found


def _stem_parts(word: str) -> list[int]:
    letters = _LETTERS.sub("", word.lower())
    if not letters:
        return []
    starts = [letters[:n] for n in range(4, 8) if n < len(letters)]
    return [_hashed("word", letters), *[_hashed("start", start) for start in starts]]


_RUNS = [(regex.compile(p), by) for p, by in ((r"\p{Lu}+", "A"), (r"(?:(?!A)\p{L})+", "a"), (r"\p{N}+", "0"))]


def shape(word: str) -> str:
    """Runs of capitals, other letters and digits as one sign each, at most 12 signs."""
    for pattern, by in _RUNS:
        word = pattern.sub(by, word)
    return word[:12]


def _shape_parts(word: str) -> list[int]:
    return [_hashed("word", word), _hashed("shape", shape(word))]


class Stems:
    """Words and their beginnings, each once, and once more if met again in the text."""

    def __init__(self):
        self.words = _Words(_stem_parts)

    def __call__(self, text: str | None) -> np.ndarray:
        numbers: list[int] = []
        for word, times in Counter((text or "").split()).items():
            parts = self.words[word]
            numbers += parts
            if times > 1:
                numbers += parts
        found, times = np.unique(np.array(numbers, np.int64), return_counts=True)
        again = (found[times > 1] * 40503 + 7) & _MASK
        return np.union1d(found, again).astype(np.int32)


class Shapes:
    """Words, their shapes, and pairs of neighbouring shapes, each once."""

    def __init__(self):
        self.words = _Words(_shape_parts)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.empty(0, np.int32)
        look = self.words.__getitem__
        numbers = np.array([look(word) for word in words], np.int64)
        shapes = numbers[:, 1]
        pairs = (shapes[:-1] * 7919 + shapes[1:] * 104729 + 13) & _MASK
        return np.unique(np.concatenate([numbers.ravel(), pairs])).astype(np.int32)


def featured(documents: DataFrame, features: type, text_col: str = "text") -> DataFrame:
    """``documents`` with ``features`` (numbers as bytes) in place of the text."""
    kept = documents.drop("features")
    names = [c for c in kept.columns if c != text_col]
    fields = [f for f in kept.schema.fields if f.name != text_col]
    schema = T.StructType([*fields, T.StructField("features", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = features()
        for batch in batches:
            found = [make(text).tobytes() for text in batch.column(text_col).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], names=[*names, "features"])

    return kept.mapInArrow(run, schema)


@dataclass(frozen=True)
class Model:
    """A linear model of features; ``squares``, where given, divide by the length of the scaled row."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    squares: np.ndarray | None = None

    def margin(self, found: np.ndarray) -> float:
        total = float(self.weights[found].sum())
        if self.squares is not None:
            total /= float(np.sqrt(self.squares[found].sum() + 1e-12))
        return total + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -40, 40))))


def constant(score: float) -> Model:
    """A model that gives every text the same score."""
    bounded = min(max(score, 1e-9), 1 - 1e-9)
    return Model(np.zeros(SIZE), float(np.log(bounded / (1 - bounded))))


def scored(
    documents: DataFrame, features: type, model: Model, score_col: str, text_col: str = "text"
) -> DataFrame:
    """``documents`` with the model's score of each whole text."""
    kept = documents.drop(score_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(score_col, T.DoubleType())])
    shared = kept.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, score = features(), shared.value.score
        for batch in batches:
            out = pa.array([score(make(text)) for text in batch.column(text_col).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, score_col])

    return kept.mapInArrow(run, schema)


def fold(doc_id: Column, folds: int) -> Column:
    """Remainder of the id's CRC; a null id has remainder -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def fetched(
    documents: DataFrame, ids: DataFrame, features: type, limit: int, id_col: str = "doc_id", text_col: str = "text"
) -> list[tuple[int, float, np.ndarray]]:
    """(hash, label, features) of the documents named by (sample_id, label).

    ``ids`` has at most ``limit`` rows, and as many documents come to the driver
    at most, also where ids repeat.
    """
    chosen = documents.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("text")).join(
        F.broadcast(ids), "sample_id"
    )
    rows = (
        featured(chosen, features)
        .orderBy(F.xxhash64("sample_id"), "sample_id", "label", "features")
        .limit(limit)
        .select(F.xxhash64("sample_id").alias("spot"), "label", "features")
        .collect()
    )
    return [(row.spot, float(row.label), np.frombuffer(row.features, np.int32)) for row in rows]


def rows_of(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Flat feature numbers and where each row begins."""
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    flat = np.concatenate(lists) if lists else np.empty(0, np.int32)
    return flat, starts


def margins(flat: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(weights[flat], dtype=np.float64)])
    return sums[starts[1:]] - sums[starts[:-1]]


def apart(hashes: list[int], label: np.ndarray) -> np.ndarray:
    """The quarter of the rows kept out of a fit; none if either part would lack a class."""
    out = np.array([spot % 4 == 0 for spot in hashes], bool)
    for part in (label[out], label[~out]):
        if len(part) == 0 or part.min() == part.max():
            return np.zeros(len(out), bool)
    return out


def calibrated(
    margin: np.ndarray, label: np.ndarray, rounds: int = 60, count: np.ndarray | None = None
) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits labels to margins (Newton's method).

    The targets are drawn in as usual for few examples.  With one class only the
    margin stays as it is.  ``count``: how many examples each row stands for, else one.
    """
    times = np.ones(len(label)) if count is None else count
    high, low = (label * times).sum(), ((1 - label) * times).sum()
    if not high or not low:
        return 1.0, 0.0
    wanted = np.where(label > 0, (high + 1) / (high + 2), 1 / (low + 2))
    scale = max(float(np.abs(margin).max()), 1e-9)
    x = np.stack([margin / scale, np.ones_like(margin)], 1)
    fit = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
        gradient = x.T @ ((p - wanted) * times) + 1e-4 * fit
        curve = (x * ((p * (1 - p) + 1e-9) * times)[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        fit = fit - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return max(float(fit[0]), 1e-6) / scale, float(fit[1])


def least_cost(margin: np.ndarray, label: np.ndarray, prior: float) -> float:
    """The margin at which to part the classes: least errors where positives have the share ``prior``.

    Of equally good places the middle of the first run of them is taken.
    """
    high, low = max(label.sum(), 1.0), max((1 - label).sum(), 1.0)
    weight = np.where(label > 0, prior / high, -(1 - prior) / low)
    order = np.argsort(margin, kind="stable")
    ascending = margin[order]
    # Cost of a cut before each row: positives below it are missed, clean rows above it are taken.
    cost = np.concatenate([[0.0], np.cumsum(weight[order])])
    cuts = np.concatenate([[ascending[0] - 1.0], (ascending[1:] + ascending[:-1]) / 2, [ascending[-1] + 1.0]])
    good = np.flatnonzero(cost <= cost.min() + 1e-12)
    breaks = np.flatnonzero(np.diff(good) > 1)
    last = good[breaks[0]] if len(breaks) else good[-1]
    return float((cuts[good[0]] + cuts[last]) / 2)
