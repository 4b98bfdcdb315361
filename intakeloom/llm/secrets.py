"""Secret scan: fixed formats, and a character network over every other candidate.

Base findings are the matches of three formats.  Candidates are all further runs
of key-like signs: from eight signs on, and from six after a name that speaks of
keys; letters or digits alone will do.  A convolutional network in numpy
reads each with the signs around it.  It is trained on labelled findings: of the
candidates of all rows, those that the value of a base finding overlaps are positive
and seen as their context and form show them (in a step half of the windows
without the letters before, which would name the format).  Its scores are calibrated on the
quarter kept out of training, and its threshold is the highest that keeps
``RECALL`` of the findings in that quarter, be it below one half.

* Base findings always stay.  Matches of one kind do not overlap; a match that
  fails its test is dropped and not tried again.  Spans count code points, the
  end exclusive; ``model`` spans overlap no base span and come last at a start.
* A null text counts as empty and has no findings; texts are read whole, however
  long.  Repeated rows are scanned each; other columns pass through.
* Trained on the windows of all candidates of all rows, each as often as it occurs.
  They are written once; a step of the training is a job whose tasks sum up the
  gradient over their windows.  Of a kind with many windows a step takes one of up
  to ``PARTS`` parts, the next step the next one, so that every window counts.
* The kept quarter and the parts go by hash of the window: equal windows lie in the same.
* Positives and negatives weigh the same in a step.  Of the negatives, letters alone,
  digits alone and neither weigh by how many there are, up to a third of ``limit`` each.
* With fewer than ``LEAST`` of either class, or no positive or no negative on a side of the split, there
  is no model and no ``model`` span.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intakeloom.llm.features import calibrated
from intakeloom.llm.shared import written

# The formats of base findings.
ASSIGN = re.compile(
    r"""(?a)(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")
# End of the fixed values.
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{6,}[A-Za-z0-9+/_=-]")
NAMED = re.compile(
    r"""(?i)(?:key|pwd|pass|auth|bearer|cred|secret|token|login|pin)[a-z_-]{0,16}["']?\s{0,3}(?:[:=]|is\b)?\s{0,3}["']?"""
    r"([a-z0-9+/_=-]{6,7})(?![A-Za-z0-9+/_.=-]*[A-Za-z0-9+/_=-])"
)
NAMES = ("key", "pwd", "pass", "auth", "bearer", "cred", "secret", "token", "login", "pin")
_FOLDED = "\u212a\u017f\u0130\u0131"  # outside ASCII, and yet letters of names when case is ignored
BEFORE, INSIDE, AFTER = 24, 32, 8
WIDTH, FILTERS = 4, 16
RECALL, LEAST = 0.98, 20
STEPS, PARTS, BATCH = 32, 32, 4096  # a kind has as many parts as leave ``BATCH`` windows in each
RATE = 0.05
BINS = 1 << 17
CHUNK, FLUSH = 128, 1 << 18  # windows looked at together, and written together

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(word in low for word in _WORDS) or not low.isascii() and ("ı" in low or "K" in text):
        for match in ASSIGN.finditer(text):
            if len(match[1]) >= 6:
                found.append((match.start(), 0, match.end()))
    if "AKIA" in text:
        for match in ACCESS.finditer(text):
            if match.end() - match.start() >= 20:
                found.append((match.start(), 1, match.end()))
    for match in HEX.finditer(text):
        found.append((match.start(), 2, match.end()))
    return sorted(found)


def _places(low: str, word: str) -> Iterator[int]:
    at = low.find(word)
    while at >= 0:
        yield at
        at = low.find(word, at + 1)


def _named(text: str) -> Iterator[re.Match]:
    """What ``NAMED.finditer`` gives, tried only where a name begins."""
    if not text.isascii() and any(sign in text for sign in _FOLDED):
        yield from NAMED.finditer(text)
        return
    low = text.lower()  # as long as the text, without those signs
    end = 0
    for at in sorted({at for name in NAMES for at in _places(low, name)}):
        if at >= end and (match := NAMED.match(text, at)):
            yield match
            end = match.end()


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of key-like signs of some length, shorter ones where a name is before them."""
    found = [match.span() for match in CANDIDATE.finditer(text)]
    starts = [start for start, _ in found]
    short = []
    for match in _named(text):
        start, end = match.span(1)
        at = bisect_right(starts, start) - 1
        if (at < 0 or found[at][1] <= start) and (at + 1 == len(found) or end <= starts[at + 1]):
            short.append((start, end))
    return sorted(found + short) if short else found


_SIGNS = "abcdefghijklmnopqrstuvwxyz"
_CLASSES = 2 * len(_SIGNS) + 9
_LETTER = np.uint8(_CLASSES - 2)  # one outside ASCII, or one not shown


def _class(sign: str) -> int:
    """Letters each on their own, capitals apart; other signs by kind; 0 is none."""
    if "a" <= sign <= "z":
        return 1 + ord(sign) - ord("a")
    if "A" <= sign <= "Z":
        return 1 + len(_SIGNS) + ord(sign) - ord("A")
    kind = 2 * len(_SIGNS) + 1
    if sign.isdigit():
        return kind
    if sign in "\"'":
        return kind + 1
    if sign in "=:":
        return kind + 2
    if sign in "+/":
        return kind + 3
    if sign in "_-.":
        return kind + 4
    if sign.isspace():
        return kind + 5
    return int(_LETTER) if sign.isalpha() else kind + 7


@cache
def _table() -> np.ndarray:
    """Class of every code point."""
    return np.array([_class(chr(code)) for code in range(0x110000)], np.uint8)


def windows(text: str, places: list[tuple[int, int]]) -> np.ndarray:
    """Sign classes before, inside (first and last half if long) and after each candidate."""
    codes = np.zeros(len(text) + BEFORE + INSIDE + AFTER, np.uint8)
    for at in range(0, len(text), 1 << 20):
        piece = np.frombuffer(text[at : at + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes[BEFORE + at : BEFORE + at + len(piece)] = _table()[piece]
    start, end = (np.array(side, np.int64)[:, None] for side in zip(*places))
    step = np.arange(INSIDE)[None, :]
    head = (end - start <= INSIDE) | (step < INSIDE // 2)
    middle = codes[BEFORE + np.where(head, start + step, end - INSIDE + step)]
    middle[step >= end - start] = 0
    return np.concatenate([codes[start + np.arange(BEFORE)], middle, codes[BEFORE + end + np.arange(AFTER)]], 1)


def _logistic(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


@dataclass
class Network:
    """One convolution over one-hot sign classes (a row of ``filters`` each), the largest answers, one output."""

    filters: np.ndarray
    offsets: np.ndarray
    outputs: np.ndarray
    bias: float
    threshold: float = 0.5
    slope: float = 1.0
    shift: float = 0.0

    def _pairs(self) -> list[np.ndarray]:
        """What two signs one after the other add to each filter, by the first two and the last two places."""
        return [
            (self.filters[k][:, None] + self.filters[k + 1][None, :]).reshape(-1, FILTERS) for k in range(0, WIDTH, 2)
        ]

    def _answers(self, codes: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
        """The answers by step, window and filter."""
        two = np.ascontiguousarray((codes[:, :-1].astype(np.int64) * _CLASSES + codes[:, 1:]).T)
        steps = codes.shape[1] - WIDTH + 1
        answers = np.take(pairs[0], two[:steps], 0)
        answers += np.take(pairs[1], two[2 : 2 + steps], 0)
        return answers

    def _margin(self, most: np.ndarray) -> np.ndarray:
        return most @ self.outputs + self.bias

    def margins(self, codes: np.ndarray) -> np.ndarray:
        pairs = self._pairs()
        margins = [
            self._margin(np.maximum(self._answers(codes[at : at + CHUNK], pairs).max(0) + self.offsets, 0))
            for at in range(0, len(codes), CHUNK)
        ]
        return np.concatenate(margins) if margins else np.empty(0)

    def reach(self) -> float:
        """No margin is further from 0."""
        most = np.maximum(self.filters.max(1).sum(0) + self.offsets, 0)
        return float(most @ np.abs(self.outputs)) + abs(self.bias) + 1e-6

    def score(self, codes: np.ndarray) -> np.ndarray:
        return _logistic(self.slope * self.margins(codes) + self.shift)

    def gradient(self, codes: np.ndarray, label: np.ndarray, weight: np.ndarray, hidden: np.ndarray) -> np.ndarray:
        """Of the weighed log loss: a sum over the windows; those ``hidden`` show no letters before the candidate."""
        turned = np.zeros((WIDTH, _CLASSES * FILTERS))
        lifts, outs, bias = np.zeros(FILTERS), np.zeros(FILTERS), 0.0
        pairs = self._pairs()
        steps = codes.shape[1] - WIDTH + 1
        back = np.arange(steps - 1, -1, -1, np.uint8)[:, None, None]
        before = np.arange(codes.shape[1])[None, :] < BEFORE
        filters = np.arange(FILTERS)
        for at in range(0, len(codes), CHUNK):
            some = slice(at, at + CHUNK)
            seen = codes[some]
            unseen = hidden[some, None] & (seen > 0) & (seen <= 2 * len(_SIGNS)) & before
            seen = np.where(unseen, _LETTER, seen)
            answers = self._answers(seen, pairs)
            best = answers.max(0)
            spot = steps - 1 - ((answers == best) * back).max(0).astype(np.int64)  # the first of the largest
            most = np.maximum(best + self.offsets, 0)
            error = ((_logistic(self._margin(most)) - label[some]) * weight[some]).astype(np.float32)
            lifted = np.outer(error, self.outputs) * (most > 0)
            for k in range(WIDTH):
                met = np.take_along_axis(seen, spot + k, 1).astype(np.int64) * FILTERS + filters
                turned[k] += np.bincount(met.ravel(), lifted.ravel(), _CLASSES * FILTERS)
            lifts += lifted.sum(0)
            outs += most.T @ error
            bias += float(error.sum())
        return np.concatenate([turned.ravel(), lifts, outs, [bias]])

    @classmethod
    def descended(cls, gradient: Callable[[Network, int], np.ndarray], seed: int = 3) -> Network:
        """Trained by ``STEPS`` steps (Adam), each along what ``gradient`` gives for the network and the step's number."""
        draw = np.random.default_rng(seed)
        size = WIDTH * _CLASSES * FILTERS
        values = np.concatenate([draw.normal(0, 0.2, size), np.zeros(FILTERS), draw.normal(0, 0.3, FILTERS), [0.0]])
        mean, square = np.zeros_like(values), np.zeros_like(values)

        def made() -> Network:
            low = values.astype(np.float32)
            filters, offsets, outputs, _ = np.split(low, [size, size + FILTERS, size + 2 * FILTERS])
            return cls(filters.reshape(WIDTH, _CLASSES, FILTERS), offsets, outputs, float(values[-1]))

        for step in range(STEPS):
            slope = gradient(made(), step)
            mean = 0.9 * mean + 0.1 * slope
            square = 0.99 * square + 0.01 * slope * slope
            rate = RATE * (1 - 0.9 * step / STEPS)
            values -= rate * (mean / (1 - 0.9 ** (step + 1))) / (np.sqrt(square / (1 - 0.99 ** (step + 1))) + 1e-8)
        return made()

    @classmethod
    def trained(cls, codes: np.ndarray, label: np.ndarray, seed: int = 3) -> Network:
        """Trained on all windows in each step."""
        share = label.mean()
        weight = np.where(label > 0, 0.5 / share, 0.5 / (1 - share)) / len(label)
        odd = (_hashes(codes) >> np.uint64(16)) & np.uint64(1)
        return cls.descended(lambda net, step: net.gradient(codes, label, weight, (odd + np.uint64(step)) % 2 == 1), seed)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """A number for each window, the same for equal ones."""
    mixed = np.zeros(len(codes), np.uint64)
    for column in np.ascontiguousarray(codes, np.uint8).view(np.uint64).T:
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return mixed


def _parts(codes: np.ndarray) -> np.ndarray:
    """The part of each window: -1 in the quarter kept out of training, else below ``PARTS``."""
    hashes = _hashes(codes)
    return np.where(hashes % 4 == 0, -1, ((hashes >> np.uint64(2)) % PARTS).astype(np.int8)).astype(np.int8)


class Covered:
    """Spans put together, to tell in logarithmic time whether a place overlaps one of them."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(end, self.ends[-1])
            else:
                self.starts.append(start)
                self.ends.append(end)

    def overlaps(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end) - 1
        return at >= 0 and self.ends[at] > start


def marked(text: str) -> tuple[list[tuple[int, int]], list[int], list[Span]]:
    """Candidates to learn from, their kinds and the base findings: 0 in a finding, else 1 letters, 2 digits, 3 other signs too.

    What a base finding covers besides its value, as the name before it, is left out.
    """
    every = candidates(text)
    if not every:
        return [], [], []
    base = base_spans(text)
    whole = Covered([(start, end) for start, _, end in base])
    values = Covered([(start if kind else ASSIGN.match(text, start).start(1), end) for start, kind, end in base])
    places, kinds = [], []
    for start, end in every:
        if not base or not whole.overlaps(start, end):
            run = text[start:end]
            kind = 1 if run.isalpha() else 2 if run.isdigit() else 3
        elif values.overlaps(start, end):
            kind = 0
        else:
            continue
        places.append((start, end))
        kinds.append(kind)
    return places, kinds, base


def _windows(documents: DataFrame, text_col: str) -> DataFrame:
    """The windows of all candidates of all rows: kind, part, window."""

    def batch_of(codes: np.ndarray, kinds: np.ndarray) -> pa.RecordBatch:
        parts = _parts(codes)
        order = np.lexsort((parts, kinds))  # so that a step finds its part in few pages
        codes = np.ascontiguousarray(codes[order])
        ends = np.arange(0, codes.size + 1, codes.shape[1], np.int32)
        window = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(ends), pa.py_buffer(codes)])
        return pa.RecordBatch.from_arrays(
            [pa.array(kinds[order], pa.int8()), pa.array(parts[order], pa.int8()), window], names=["kind", "part", "window"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                places, kinds, _ = marked(text or "")
                for at in range(0, len(places), 8192):
                    held.append((windows(text, places[at : at + 8192]), np.array(kinds[at : at + 8192], np.int8)))
                    size += len(held[-1][1])
                    if size >= FLUSH:
                        yield batch_of(*map(np.concatenate, zip(*held)))
                        held, size = [], 0
        if held:
            yield batch_of(*map(np.concatenate, zip(*held)))

    return written(
        documents.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "kind tinyint, part tinyint, window binary"),
        "secret-windows",
    )


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("window")
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)


def _trained(windows: DataFrame, counts: dict[tuple[int, int], int], limit: int) -> Network:
    """The network after ``STEPS`` jobs, each summing the gradient over its parts of the windows."""
    sums = {kind: sum(n for (k, part), n in counts.items() if k == kind and part >= 0) for kind in range(4)}
    cycle = {kind: min(PARTS, 1 << max(1, n // BATCH).bit_length() - 1) for kind, n in sums.items()}
    share = np.array([0] + [min(sums[kind], -(-limit // 3)) for kind in (1, 2, 3)], float)
    share *= 0.5 / share.sum()
    share[0] = 0.5

    def gradient(net: Network, step: int) -> np.ndarray:
        taken = {kind: [part for part in range(PARTS) if part % turn == step % turn] for kind, turn in cycle.items()}
        number = [sum(counts.get((kind, part), 0) for part in parts) for kind, parts in taken.items()]
        weights = share / np.maximum(number, 1)
        turns = np.array([step // turn for turn in cycle.values()], np.uint64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    codes, kind = _codes(batch), batch.column("kind").to_numpy()
                    hidden = ((_hashes(codes) >> np.uint64(16)) + turns[kind]) % 2 == 1
                    part = net.gradient(codes, (kind == 0).astype(float), weights[kind], hidden)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["gradient"])

        chosen = reduce(or_, [(F.col("kind") == kind) & F.col("part").isin(parts) for kind, parts in taken.items()])
        found = windows.where(chosen).select("kind", "window").mapInArrow(run, "gradient binary").collect()
        return np.sum([np.frombuffer(row.gradient) for row in found], axis=0)

    return Network.descended(gradient)


def _spread(windows: DataFrame, net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The margins of the windows kept out of training, rounded down to one of ``BINS`` steps: margin, label, count."""
    step = 2 * net.reach() / BINS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.floor(net.margins(_codes(batch)).astype(np.float64) / step).astype(np.int64)
                rows, count = np.unique(2 * at + (batch.column("kind").to_numpy() == 0), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(count.astype(np.int64))], names=["row", "count"])

    counted = windows.where("part = -1").select("kind", "window").mapInArrow(run, "row bigint, count bigint")
    found = sorted(counted.groupBy("row").agg(F.sum("count").alias("count")).collect())
    rows = np.array([row["row"] for row in found], np.int64)
    return (rows >> 1) * step, (rows & 1).astype(float), np.array([row["count"] for row in found], float)


def fit(documents: DataFrame, limit: int = 4000, text_col: str = "text") -> Network | None:
    windows = _windows(documents, text_col)
    counts = {(row["kind"], row["part"]): row["count"] for row in windows.groupBy("kind", "part").count().collect()}
    number = np.zeros((2, 2))  # by label, in training or not
    for (kind, part), count in counts.items():
        number[int(kind == 0), int(part >= 0)] += count
    if number.sum(1).min() < LEAST or number.min() == 0:
        return None
    net = _trained(windows, counts, limit)
    return _bounded(net, *_spread(windows, net))


def bounded(net: Network, codes: np.ndarray, label: np.ndarray) -> Network:
    """The network with scores calibrated on held-out windows and the threshold that keeps their findings."""
    return _bounded(net, net.margins(codes).astype(np.float64), label, np.ones(len(label)))


def _bounded(net: Network, margin: np.ndarray, label: np.ndarray, count: np.ndarray) -> Network:
    net.slope, net.shift = calibrated(margin, label, count=count)
    order = np.argsort(margin[label > 0], kind="stable")
    below = np.cumsum(count[label > 0][order])
    bar = margin[label > 0][order][np.searchsorted(below, int((1 - RECALL) * below[-1]), side="right")]
    net.threshold = float(_logistic(net.slope * bar + net.shift)) * (1 - 1e-6)  # not above it by rounding
    return net


def spans(texts: list[str | None], net: Network | None) -> list[list[Span]]:
    """All findings of each text: base spans and what the network adds."""
    found = [base_spans(text or "") for text in texts]
    if net is None:
        return found
    added: list[tuple[int, int, int]] = []  # row, start, end
    held: list[tuple[int, list[tuple[int, int]], np.ndarray]] = []  # windows of several texts are scored together
    size = 0

    def score() -> None:
        good = np.flatnonzero(net.score(np.concatenate([codes for _, _, codes in held])) >= net.threshold)
        if len(good):
            places = [(row, start, end) for row, some, _ in held for start, end in some]
            added.extend(places[k] for k in good)
        held.clear()

    for row, (text, base) in enumerate(zip(texts, found)):
        places = candidates(text or "")
        if base:
            whole = Covered([(a, b) for a, _, b in base])
            places = [(s, e) for s, e in places if not whole.overlaps(s, e)]
        for at in range(0, len(places), 8192):
            some = places[at : at + 8192]
            held.append((row, some, windows(text or "", some)))
            size += len(some)
            if size >= 8192:
                score()
                size = 0
    if held:
        score()
    for row, start, end in added:
        found[row].append((start, 3, end))
    return [sorted(row) for row in found]


def written_out(found: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def scanned(
    documents: DataFrame, limit: int = 4000, id_col: str = "doc_id", text_col: str = "text", spans_col: str = "secret_spans"
) -> DataFrame:
    """``documents`` with the findings of every whole text: kind, start and end, by start; ids are not read."""
    kept = documents.drop(spans_col)
    net = documents.sparkSession.sparkContext.broadcast(fit(documents, limit, text_col))
    kind = T.ArrayType(
        T.StructType(
            [
                T.StructField("kind", T.StringType()),
                T.StructField("start", T.LongType()),
                T.StructField("end", T.LongType()),
            ]
        )
    )
    schema = T.StructType([*kept.schema.fields, T.StructField(spans_col, kind)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = spans(batch.column(text_col).to_pylist(), net.value)
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in row] for row in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rows, arrow)], names=[*batch.schema.names, spans_col]
            )

    return kept.mapInArrow(run, schema)
