"""License scan: against a plain scan of every block with every template."""

import re

import pytest
from pyspark.sql import functions as F

from intakeloom.llm import licenses

NAMES = ("row", "block", "word", "words", "held", "label", "place", "shared", "template", "rank", "need", "n", "score")


def plain(text, given):
    """n_words, n_base, first, last, base labels, labels, score."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(licenses.WORD, lowered)
    places, base, labels, score = [], set(), set(), 0.0
    for one in given:
        m = len(one.words)
        if one.phrase:
            at = [k for k in range(len(words)) if tuple(words[k : k + m]) == one.words]
            places += at
            if at:
                base.add(one.label)
                score = 1.0
            continue
        for start in range(0, len(words), licenses.STEP):
            common = set(words[start : start + licenses.BLOCK]) & set(one.words)
            if len(common) >= one.need:
                labels.add(one.label)
                score = max(score, len(common) / len(set(one.words)))
    return (len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(base | labels), score)


def agree(frame, given=None):
    found = licenses.scanned(frame, given).collect()
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in found]
    wanted = [(row.doc_id, *plain(row.text, given or licenses.templates())) for row in frame.collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    return {row[0]: row[1:] for row in got}


def test_odd_rows(odd, empty):
    agree(odd.select("*", *[F.lit("x").alias(name) for name in NAMES if name not in odd.columns]))
    assert licenses.scanned(empty).count() == 0


def test_places_and_labels(spark):
    mit = next(text for text, label in licenses.NOTICES.items() if label == "mit-notice")
    some = mit.split()
    rows = [
        (1, "MIT License, mit-license; the mit\n\nlicenses. CC BY cc, by 4.0 ccby"),
        (2, "filler " * 31 + "GNU General / Public License " + "filler " * 60 + "apache license"),
        (3, "own words " * 20 + mit + " more words" * 40),
        (4, " ".join(some[: len(some) * 9 // 10]) + " and a changed end"),
        (5, " ".join(some[: len(some) // 2])),
        (6, "MİT License, Kpache license, écc by, cc byé gnu general public ıicense"),
        (7, "cc by " * 5000),
        (8, "x" * 100_000 + " mit license " + "word " * 100_000 + "gnu general public license"),
        (9, "license mit"), (10, "license of mit, by cc and gnu public general license"),
    ]
    found = agree(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert found[1][1:3] == (4, 0) and found[1][4] == ["cc-by", "mit"]
    assert found[2][1:4] == (2, 31, 95) and found[2][4] == ["apache", "gpl"]
    assert "mit-notice" in found[3][5] and found[3][6] == 1.0
    assert "mit-notice" in found[4][5] and found[4][6] < 1.0
    assert found[5][5] == [] and found[6][1] == 0 and found[7][1] == 5000
    assert found[10][1] == 0 and found[10][4] == []


def test_own_templates(spark):
    """Longer templates are cut, common words in templates prune nothing that meets."""
    long = " ".join(f"w{k % 37}" for k in range(80))
    given = licenses.templates({"the": "the", "a b a": "aba"}, {long: "long", "of the and a to in": "common", "the": "one"}, 70)
    rows = [(k, " ".join(("the", "of", "and", "a", "b", "to", "in", f"w{k % 40}")[(k * 7 + j * j) % 8] for j in range(k))) for k in range(150)]
    rows += [(200, long), (201, long[:100]), (202, "a b a b a b a")]
    found = agree(spark.createDataFrame(rows, "doc_id bigint, text string"), given)
    assert found[202][1] == 3 and found[200][5] == ["long"]
    assert agree(spark.createDataFrame([(1, "a text")], "doc_id bigint, text string"), [])[1][1] == 0


def test_bounds():
    with pytest.raises(ValueError):
        licenses.templates({" ".join(["word"] * 40): "long phrase"}, {})
    with pytest.raises(ValueError):
        licenses.templates({}, {" ".join(f"w{k}" for k in range(licenses.MOST_WORDS + 40)): "too many"})
