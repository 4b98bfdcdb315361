"""Phrase collocations: counts of all phrases by a multikey quicksort of suffix pointers, then scores of their cuts.

Every word of a piece begins a suffix of at most ``DEPTH`` words.  Suffixes are
dealt to routes by their leading word; a route sorts pointers to its suffixes by
three-way partitions, word after word.  The equal partition at a depth holds
all occurrences of one phrase, so its size is the phrase's count; partitions
below ``least`` are abandoned, as no phrase in them can reach it.

* A survey of all texts counts words in ``2^SKETCH`` buckets.  A word whose bucket
  stays below ``least`` is in no candidate and ends suffixes before they are sent;
  this drops nothing that counts, however full the buckets are.
* Equal suffixes of a chunk of text travel once, with their number, so copies
  and common phrases do not fill a route.
* Leading words (pairs, triples) of more than a share of ``1 / HOT`` of all words
  are dealt by one word more.  Their own counts are then sums over routes, and
  nothing above the word dealt by is abandoned.
* The number of routes grows with the number of words.
* Counting and pieces: A-Z are lower-cased; a piece ends at ``.,;:!?`` and at line
  ends, words end at blanks and tabs.  Texts are read whole; very long ones are
  cut between pieces.
* A null language counts as ``und``; a null or empty text has no words.  Repeated
  rows count each.  Ids and other columns take no part, whatever their names.
* A phrase has one count and one score per language; equal scores and counts are
  ranked by the phrase's bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intakeloom.llm.shared import written

DEPTH, LEAST, CONTAINED, TOP = 4, 30, 80, 2000
SKETCH, SLICE, SALTS = 20, 1 << 14, 32
HOT, SEEN = 256, 1 << 16
CHUNK, ROUTE_WORDS, ROUTES = 8 << 20, 1 << 20, 4

_SIGN = np.zeros(256, np.uint8)
_SIGN[[0x20, 0x09]] = 1
_SIGN[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_END = re.compile("[.,;:!?\x0a-\x0d]")


def pieces_of(text: str) -> Iterator[str]:
    """The text in parts of about ``CHUNK`` signs, cut where pieces end."""
    start = 0
    while len(text) - start > CHUNK:
        cut = _END.search(text, start + CHUNK)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:] if start else text


class Words:
    """The words of texts in one language: numbers into a list of different words, and which are neighbours."""

    def __init__(self, language: str, texts: list[str]):
        data = np.frombuffer("\n".join(texts).encode(), np.uint8)
        sign = _SIGN[data]
        inside = sign == 0
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        starts, ends = edge[::2], edge[1::2]
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=offsets[1:])
        letters = _LOWER[data[inside]]
        array = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        coded = array.dictionary_encode()
        self.language = language
        self.number = coded.indices.to_numpy(zero_copy_only=False)
        self.words = coded.dictionary
        piece = np.searchsorted(np.flatnonzero(sign == 2), starts)
        #: Whether the word's next one is in the same piece.
        self.linked = np.append(piece[1:] == piece[:-1], False) if len(piece) else np.zeros(0, bool)
        seed = xxhash.xxh64_intdigest(language.encode())
        self.hash = np.array([xxhash.xxh64_intdigest(word, seed) for word in self.words.to_pylist()], np.uint64)


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of two hashes in their order."""
    turned = (second >> np.uint64(29)) | (second << np.uint64(35))
    return (first * np.uint64(0x9E3779B97F4A7C15) + turned) * np.uint64(0xC2B2AE3D27D4EB4F)


def seen(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def sketched(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH)).astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Texts of each language in chunks; never much more than ``CHUNK`` signs wait."""
    waiting: dict[str, list[str]] = {}
    size = 0
    for batch in batches:
        for language, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for part in pieces_of(text.as_py()):
                waiting.setdefault(language, []).append(part)
                size += len(part) + 1
                if size >= CHUNK:
                    yield from (Words(*item) for item in waiting.items())
                    waiting, size = {}, 0
    yield from (Words(*item) for item in waiting.items())


SURVEY = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("salt", pa.int32()), ("data", pa.binary()), ("n", pa.int64())])


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a split: words by bucket (up to 255), leading phrases that stand out, words by language."""
    buckets = np.zeros(1 << SKETCH, np.int64)
    leading = np.zeros((DEPTH - 1, SEEN), np.int64)
    languages: dict[str, int] = {}
    for chunk in chunks(batches):
        languages[chunk.language] = languages.get(chunk.language, 0) + len(chunk.number)
        if not len(chunk.number):
            continue
        counts = np.bincount(chunk.number, minlength=len(chunk.words))
        np.add.at(buckets, sketched(chunk.hash), counts)
        phrase = every = chunk.hash[chunk.number]
        whole = np.ones(len(phrase), bool)
        for depth in range(DEPTH - 1):
            if depth:
                whole = whole[:-1] & chunk.linked[depth - 1 : len(whole) + depth - 2]
                phrase = mixed(phrase[:-1], every[depth:])
            leading[depth] += np.bincount(seen(phrase[whole]), minlength=SEEN)
    total = sum(languages.values())
    salt = TaskContext.get().partitionId() % SALTS
    rows = [("language:" + language, 0, salt, None, n) for language, n in languages.items()]
    for depth, part in zip(*np.nonzero(leading * 4 * HOT > total)):
        rows.append((f"leading:{depth + 1}", int(part), salt, None, int(leading[depth, part])))
    if total:
        short = np.minimum(buckets, 255).astype(np.uint8)
        rows += [("words", k, salt, short[k * SLICE : (k + 1) * SLICE].tobytes(), 0) for k in range((1 << SKETCH) // SLICE)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t.type) for x, t in zip(zip(*rows), SURVEY)], schema=SURVEY)


def _summed(table: pa.Table) -> pa.Table:
    """One slice of buckets, added up to 255."""
    total = np.zeros(SLICE, np.uint16)
    for data in table.column("data"):
        total = np.minimum(total + np.frombuffer(data.as_buffer(), np.uint8), 255)
    out = {"part": [table.column("part")[0].as_py()], "salt": [0], "data": [total.astype(np.uint8).tobytes()]}
    return pa.table(out, pa.schema([("part", pa.int32()), ("salt", pa.int32()), ("data", pa.binary())]))


class Plan:
    """What the survey tells: words that may be frequent, leading phrases to be dealt further, the number of routes."""

    def __init__(self, survey: DataFrame, least: int, partitions: int):
        slices = survey.where("kind = 'words'").select("part", "salt", "data")
        shape = "part int, salt int, data binary"
        slices = slices.groupBy("part", "salt").applyInArrow(_summed, shape).groupBy("part").applyInArrow(_summed, shape)
        known = np.zeros(1 << SKETCH, np.uint8)
        for row in slices.collect():  # 64 rows of 16 KB, whatever the input
            known[row.part * SLICE : (row.part + 1) * SLICE] = np.frombuffer(row.data, np.uint8)
        #: A bit for each bucket: beyond what a byte counts to, none is ruled out.
        self.frequent = np.packbits(known >= min(least, 255))
        total = survey.where("kind LIKE 'language:%'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        hot = survey.where("kind LIKE 'leading:%'").groupBy("kind", "part").agg(F.sum("n").alias("n"))
        #: At most ``HOT`` for each depth, as their counts add up to the total at most.
        hot = hot.where(F.col("n") * HOT > total).collect()
        self.hot = [np.array(sorted(row.part for row in hot if row.kind == f"leading:{depth + 1}"), np.int64) for depth in range(DEPTH - 1)]
        self.routes = max(ROUTES * partitions, total // ROUTE_WORDS + 1)
        self.least = least


SENT = pa.schema([
    ("route", pa.int32()), ("dealt", pa.int32()), ("lang", pa.string()), ("m", pa.int32()),
    ("words", pa.binary()), ("codes", pa.binary()), ("counts", pa.binary()),
])


def smallest(values: np.ndarray) -> np.ndarray:
    """The values in the narrowest unsigned type."""
    most = int(values.max(initial=0))
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def widened(data: bytes, n: int) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(data) // n]
    return np.frombuffer(data, kind).astype(np.int64)


def suffixes(chunk: Words, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different suffixes as ``DEPTH`` rows of codes (0: ended), their counts, and the words' numbers by code."""
    at = sketched(chunk.hash)
    may = (plan.frequent[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
    kept = np.flatnonzero(may)
    code = np.zeros(len(chunk.words) + 1, np.int64)
    code[kept] = np.arange(1, len(kept) + 1)
    first = code[chunk.number]
    rows = np.flatnonzero(first)
    columns = [first[rows]]
    padded, linked = np.append(first, np.zeros(DEPTH, np.int64)), np.append(chunk.linked, np.zeros(DEPTH, bool))
    open_ = np.ones(len(rows), bool)
    for depth in range(1, DEPTH):
        open_ &= linked[rows + depth - 1]
        after = padded[rows + depth] * open_
        open_ &= after > 0
        columns.append(after)
    base = len(kept) + 1
    high, low = columns[0] * base + columns[1], columns[2] * base + columns[3]
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))) if len(order) else order
    counts = np.diff(np.append(new, len(order)))
    return np.stack([column[order[new]] for column in columns]), counts, kept


def dealt(codes: np.ndarray, hashes: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Each suffix's route and the number of leading words it is dealt by."""
    route = hashes[codes[0]]
    phrase, words = route, np.ones(codes.shape[1], np.int64)
    hot = np.ones(codes.shape[1], bool)
    for depth in range(1, DEPTH):
        hot = hot & np.isin(seen(phrase), plan.hot[depth - 1])
        phrase = mixed(phrase, hashes[codes[depth]])
        route = np.where(hot, phrase, route)
        words += hot
    return ((route >> np.uint64(17)) % np.uint64(plan.routes)).astype(np.int64), words


def _sent(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for chunk in chunks(batches):
            codes, counts, kept = suffixes(chunk, plan)
            if not codes.shape[1]:
                continue
            hashes = np.append(np.uint64(0), chunk.hash[kept])
            route, by = dealt(codes, hashes, plan)
            key = route * (DEPTH + 1) + by
            order = np.argsort(key, kind="stable")
            codes, counts, key = codes[:, order], counts[order], key[order]
            edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            names = chunk.words.take(pa.array(kept))
            own = np.zeros(len(kept) + 1, np.int64)
            rows = []
            for start, end in zip(edges[:-1], edges[1:]):
                part = codes[:, start:end]
                marked = np.zeros(len(kept) + 1, bool)
                marked[part] = True
                marked[0] = False
                used = np.flatnonzero(marked)
                own[used] = np.arange(1, len(used) + 1)
                words = b" ".join(names.take(pa.array(used - 1)).to_pylist())
                packed = smallest(own[part])
                n = smallest(counts[start:end])
                where, depth = divmod(int(key[start]), DEPTH + 1)
                rows.append((where, depth, chunk.language, int(end - start), pack(words), pack(packed.tobytes()), pack(n.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t.type) for x, t in zip(zip(*rows), SENT)], schema=SENT)

    return run


def frequent(codes: np.ndarray, counts: np.ndarray, least: int, dealt_by: int) -> list[tuple[list[int], int]]:
    """Phrases with their counts, by multikey three-way quicksort of pointers to suffixes.

    Phrases of fewer words than ``dealt_by`` may have suffixes elsewhere, so
    nothing is abandoned among them.
    """
    found = []
    waiting = [(np.arange(codes.shape[1]), 0, [])]
    while waiting:
        pointers, depth, phrase = waiting.pop()
        words = codes[depth, pointers]
        bound = 1 if depth + 1 < dealt_by else least
        pivot = words[len(words) // 2]
        for side, same in ((words < pivot, False), (words > pivot, False), (words == pivot, True)):
            part = pointers[side]
            size = int(counts[part].sum())
            if size < bound or not size:
                continue
            if not same:
                waiting.append((part, depth, phrase))
                continue
            found.append(([*phrase, int(pivot)], size))
            if depth + 1 < codes.shape[0]:
                part = part[codes[depth + 1, part] > 0]
                if len(part) and (depth + 2 < dealt_by or counts[part].sum() >= least):
                    waiting.append((part, depth + 1, [*phrase, int(pivot)]))
    return found


FOUND = "lang string, phrase string, size int, f bigint"


def _counted(least: int):
    def run(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        parts: dict[tuple[str, int], list[dict]] = {}
        for row in range(table.num_rows):
            one = {name: table.column(name)[row] for name in table.column_names}
            parts.setdefault((one["lang"].as_py(), one["dealt"].as_py()), []).append(one)
        out: list[tuple] = []
        for (language, by), rows in sorted(parts.items()):
            names: list[bytes] = []
            codes, counts = [], []
            for one in rows:
                m = one["m"].as_py()
                own = widened(unpack(one["codes"].as_buffer()), DEPTH * m).reshape(DEPTH, m)
                codes.append(np.where(own > 0, own + len(names), 0))
                counts.append(widened(unpack(one["counts"].as_buffer()), m))
                names += unpack(one["words"].as_buffer()).split(b" ")
            coded = pa.array(names, pa.binary()).dictionary_encode()
            number = np.append(0, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            phrases = frequent(number[np.concatenate(codes, axis=1)], np.concatenate(counts), least, by)
            words = [word.decode() for word in coded.dictionary.to_pylist()]
            out += [(language, " ".join(words[k - 1] for k in phrase), len(phrase), n) for phrase, n in phrases]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
        columns = zip(*out) if out else ((),) * 4
        return pa.table({name: pa.array(list(x), t) for name, x, t in zip(("lang", "phrase", "size", "f"), columns, kinds)})

    return run


def phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``DEPTH`` words that occur ``least`` times (lang, phrase, size, f), and words by language (lang, n)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    survey = written(
        texts.mapInArrow(_surveyed, "kind string, part int, salt int, data binary, n bigint"), "collocations-survey"
    )
    plan = Plan(survey, least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shape = "route int, dealt int, lang string, m int, words binary, codes binary, counts binary"
    sent = texts.mapInArrow(_sent(plan), shape)
    found = sent.groupBy("route").applyInArrow(_counted(least), FOUND)
    # Counts of phrases dealt by more words than they have are sums over routes.
    found = found.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    languages = survey.where("kind LIKE 'language:%'").groupBy(F.expr("substring(kind, 10)").alias("lang")).agg(F.sum("n").alias("n"))
    return written(found, "collocations-phrases"), languages


def part_of(start: Column, length: Column) -> Column:
    return F.array_join(F.slice("words", start, length), " ")


def exact(value: Column, factor: int) -> Column:
    return value.cast("decimal(19,0)") * F.lit(factor).cast("decimal(7,0)")


def scored(found: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, size, a) with their lowest-scoring cut: k, l, r and score."""
    candidates = found.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    words = candidates.withColumn("words", F.split("phrase", " ", -1))
    cuts = words.select("lang", "phrase", "a", "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    halves = F.array(
        F.struct(F.lit(True).alias("first"), part_of(F.lit(1), F.col("k")).alias("text")),
        F.struct(F.lit(False).alias("first"), part_of(F.col("k") + 1, F.col("size") - F.col("k")).alias("text")),
    )
    halves = cuts.select("lang", "phrase", "a", "size", "k", F.explode(halves).alias("half"))
    halves = halves.select("lang", "phrase", "a", "size", "k", "half.first", "half.text")
    known = found.select(F.col("lang").alias("known_lang"), F.col("phrase").alias("known"), "f")
    met = halves.join(known, (F.col("lang") == F.col("known_lang")) & (F.col("text") == F.col("known")))
    # Six rows for a candidate at most.
    sides = met.groupBy("lang", "phrase", "size", "a").agg(F.collect_list(F.struct("k", "first", "f")).alias("sides"))
    for k in range(1, DEPTH):
        for name, first in (("l", "s.first"), ("r", "NOT s.first")):
            sides = sides.withColumn(f"{name}{k}", F.expr(f"get(filter(sides, s -> s.k = {k} AND {first}), 0).f"))
    options = [
        F.when(F.col("size") > k, F.struct(_score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        for k in range(1, DEPTH)
    ]
    best = F.array_min(F.array_compact(F.array(*options)))
    return sides.select("lang", "phrase", "size", "a", best.alias("best")).select(
        "lang", "phrase", "size", "a", "best.l", "best.r", "best.score"
    )


def _score(k: int) -> Column:
    """Floor of a quotient of decimals, which ``div`` gives exactly."""
    return F.expr(
        "(CAST(a AS DECIMAL(19,0)) * CAST(2000000 AS DECIMAL(7,0)))"
        f" div (CAST(l{k} AS DECIMAL(19,0)) + CAST(r{k} AS DECIMAL(19,0)))"
    )


def collocations(docs: DataFrame, least: int = LEAST, contained: int = CONTAINED, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    found, languages = phrases(docs, least)
    candidates = scored(found)
    # Phrases inside longer ones, with the most frequent of these.
    longer = found.where("size > 2").withColumn("words", F.split("phrase", " ", -1))
    inside = longer.select("lang", "words", "size", "f", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("length"))
    inside = inside.select("lang", "words", "f", "length", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)).alias("start"))
    inside = inside.groupBy(F.col("lang").alias("in_lang"), part_of(F.col("start"), F.col("length")).alias("inner")).agg(F.max("f").alias("outer_f"))
    met = (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("inner"))
    held = exact(F.col("outer_f"), 100) >= exact(F.col("a"), contained)
    kept = candidates.join(inside, met, "left").where(~F.coalesce(held, F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    counted = languages.select(F.col("lang").alias("n_lang"), "n")
    return ranked.join(counted, F.col("lang") == F.col("n_lang")).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
