"""Text, name and JSON expressions on edge cases."""

import pytest
from pyspark.sql import functions as F

from intakeloom.functions import jsontext, names
from intakeloom.functions import text as t


def values(spark, rows, expression, kind="string"):
    data = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in data.orderBy("i").select(expression(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "text, valid",
    [
        ('{"a": 1}', True),
        ("null", True),
        ("12", True),
        (' "x" ', True),
        ("\n[1, 2]\t", True),
        ('{"a":1} x', False),
        ("1,2", False),
        ("1],[2", False),
        ("{a: 1}", False),
        ("", False),
        ("hello", False),
        ('{"a":1,"a":2}', True),
        (None, False),
    ],
)
def test_strict_json(spark, text, valid):
    assert values(spark, [text], jsontext.is_json) == [valid]


def test_last_duplicate_key_wins(spark):
    got = values(spark, ['{"a":1,"a":2}'], lambda v: jsontext.at(jsontext.parse(v), "a"))
    assert got == ["2"]


def test_names(spark):
    rows = ["a/b.c/report.tar.GZ", "x.pdf", ".profile", "plain", "dot."]
    assert values(spark, rows, lambda v: names.extension(names.base_name(v))) == [
        ".gz",
        ".pdf",
        "",
        "",
        "",
    ]
    assert values(spark, ["x.pdf", "y.jsonl", "z"], names.file_type) == ["pdf", None, None]
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    assert values(spark, ["x.pdf", "z"], lambda v: names.stamped_name(v, at)) == [
        "x_20240102_030405.pdf",
        "z_20240102_030405",
    ]


def test_preview_counts_characters_not_bytes(spark):
    long, short = "é" * 201, "é" * 200
    assert values(spark, [long, short], t.preview) == ["é" * 200 + "...", short]


def test_sanitize(spark):
    rows = ["  a \n\t b c  ", "", None, "abcde fgh"]
    assert values(spark, rows, t.sanitize) == ["a b c", "", "", "abcde fgh"]
    assert values(spark, ["abcde fgh"], lambda v: t.sanitize(v, 6)) == ["abcde..."]


def test_word_boundaries_are_unicode(spark):
    from intakeloom.operators import mail

    rows = ["éa@b.com x@y.deé", "mail a@b.com, c@d.org."]
    assert values(spark, rows, mail.emails) == [[], ["a@b.com", "c@d.org"]]


def test_decode(spark):
    rows = ["naïve\r\nline".encode("latin-1"), "naïve".encode(), b"a\xffb"]
    assert values(spark, rows, t.decode, "binary") == ["naïve\nline", "naïve", "aÿb"]
    assert values(spark, rows, t.text_encoding, "binary") == ["latin-1", "utf-8", "latin-1"]
    assert values(spark, rows, t.decode_lossy, "binary") == ["nave\r\nline", "naïve", "ab"]


def test_char_codes(spark):
    rows = ["72,105", "mail.txt", "300,2", "72,"]
    assert values(spark, rows, t.decode_char_codes) == ["Hi", "mail.txt", "300,2", "72,"]


def test_quick_changes_no_match():
    import re

    from intakeloom import fixed_values as fv

    texts = ["Order #: A1 ref 7 invoice-2 REFERENCE x", "date 2024-01-01 issued: 1/2/24", "none"]
    patterns = [fv.MAIL_REFERENCE, *fv.PAGE_FIELDS["invoice"].values()]
    for pattern in patterns:
        assert t.quick(pattern) != pattern
        for text in texts:
            assert re.findall(pattern, text, re.I | re.M) == re.findall(
                t.quick(pattern), text, re.I | re.M
            )
