"""Phrase collocations: against counting by dictionary, with hot words, long texts and odd rows."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from intakeloom.llm import collocations

NAMES = ("f", "a", "phrase", "words", "kind", "part", "salt", "data", "route", "rank")


def counted(rows):
    """Occurrences of every phrase of one to four words, and of words, by language."""
    counts, totals = {}, Counter()
    for language, text in rows:
        language = "und" if language is None else language
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            totals[language] += len(words)
            for size in range(1, 5):
                for k in range(len(words) - size + 1):
                    counts.setdefault(language, Counter())[tuple(words[k : k + size])] += 1
    return counts, totals


def plain(rows, least, contained, top):
    counts, totals = counted(rows)
    out = []
    for language, known in counts.items():
        kept = []
        for phrase, a in known.items():
            if len(phrase) < 2 or a < least:
                continue
            inside = any(
                len(longer) > len(phrase) and f >= least and 100 * f >= contained * a
                and any(longer[k : k + len(phrase)] == phrase for k in range(len(longer)))
                for longer, f in known.items()
            )
            if not inside:
                score, k = min((2_000_000 * a // (known[phrase[:k]] + known[phrase[k:]]), k) for k in range(1, len(phrase)))
                kept.append((-score, -a, " ".join(phrase).encode(), known[phrase[:k]], known[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((language, rank, phrase.decode(), -a, left, right, totals[language], -score))
    return sorted(out)


def agree(frame, least=3, contained=80, top=50):
    rows = [(row.lang, row.text) for row in frame.collect()]
    got = sorted(tuple(row) for row in collocations.collocations(frame, least, contained, top).collect())
    assert got == plain(rows, least, contained, top)
    return got


def test_odd_rows(odd, empty, spark):
    short = odd.where("doc_id IS NULL OR doc_id <> 4").withColumn("text", F.concat_ws(" ; ", *["text"] * 4))
    assert agree(short.select("*", *[F.lit("x").alias(name) for name in NAMES if name not in odd.columns]))
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(odd.where("text IS NULL OR text = ''")).count() == 0
    texts = ["Ünï çödé, Ünï çödé. ÜNÏ çödé\x0bünï çödé a\x00b c\x1c a\x00b c\x1c a\x00b c\x1c", "a\tb  a b\r\na b", "É é É é É é É é"]
    frame = spark.createDataFrame([(None, t) for t in texts] + [("und", "a b")], "lang string, text string")
    assert {row[0] for row in agree(frame)} == {"und"}


def test_hot_words_and_copies(spark):
    """Words, pairs and triples that lead most suffixes, beside a third of all texts that are one text."""
    draw = random.Random(5)
    rows = [("en", "the same text in one third of all rows, the same text again")] * 60
    rows += [("en", " ".join(draw.choice(["x x x", "the of", "of the of", "w%d" % draw.randrange(60)]) for _ in range(30))) for _ in range(120)]
    rows += [("fr", " ".join("ab"[draw.randrange(2)] for _ in range(50))) for _ in range(20)]
    rows += [(None, "x " * 700)]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    for least, contained in ((3, 80), (30, 80), (300, 50), (5, 100)):
        assert agree(frame, least, contained, 40)
    spread = collocations.Plan(
        frame.fillna("und").mapInArrow(collocations._surveyed, "kind string, part int, salt int, data binary, n bigint"), 30, 8
    )
    assert all(len(hot) for hot in spread.hot) and len(spread.hot) == 3


def test_long_texts(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 50)
    text = "some words here and there, " * 40 + "n" * 300 + " and on and on"
    parts = list(collocations.pieces_of(text))
    assert len(parts) > 10 and ",".join(parts) == text
    assert list(collocations.pieces_of("")) == [""] and list(collocations.pieces_of("a" * 500)) == ["a" * 500]


def test_partitions():
    """The quicksort's equal partitions are the counts, whatever the words' codes."""
    draw = np.random.default_rng(3)
    codes = draw.integers(1, 6, (4, 4000))
    codes[2, draw.random(4000) < 0.3] = 0
    codes[3, codes[2] == 0] = 0
    weights = draw.integers(1, 5, 4000)
    wanted = Counter()
    for column, weight in zip(codes.T.tolist(), weights.tolist()):
        for size in range(1, 5):
            if all(column[:size]):
                wanted[tuple(column[:size])] += weight
    for least in (1, 30, 200):
        found = {tuple(phrase): n for phrase, n in collocations.frequent(codes, weights, least, 1)}
        assert found == {phrase: n for phrase, n in wanted.items() if n >= least}
    partial = {tuple(phrase): n for phrase, n in collocations.frequent(codes, weights, 200, 3)}
    assert all(partial[phrase] == n for phrase, n in wanted.items() if len(phrase) < 3 or n >= 200)


def test_arithmetic_beyond_64_bits(spark):
    big = 4 * 10**18
    rows = [("en", "a b", 2, big - 1), ("en", "a", 1, big), ("en", "b", 1, big + 7)]
    found = spark.createDataFrame(rows, "lang string, phrase string, size int, f bigint")
    assert collocations.scored(found).first().score == 2_000_000 * (big - 1) // (2 * big + 7)
