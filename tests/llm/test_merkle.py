"""Merkle manifest: trees of every shape, odd rows, tampering."""

import pytest
from brute import merkle as plain
from pyspark.sql import functions as F

from intakeloom.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def agree(frame, **kwargs):
    rows = [tuple(row[c] for c in COLUMNS) for row in frame.collect()]
    found = merkle.proofs(frame, merkle.tampered(5), **kwargs).collect()
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.siblings, r.folded_root) for r in found]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)
    assert all(r.verified == (r.folded_root == r.root) for r in found)
    return found


def test_odd_rows(odd, empty):
    clashing = odd.select("*", *[F.lit(k).alias(name) for k, name in enumerate(("tree", "at", "leaf", "fold", "slot", "kids", "digest", "number", "copy"))])
    agree(clashing)
    assert merkle.proofs(empty).count() == 0
    assert merkle.built(empty).nodes.count() == 0


def test_one_row_one_source_many_sources(spark):
    def frame(sizes):
        rows = [
            (1000 * s + k, None if s == 3 else f"s{s}", "en", k, f"Text {k} OF {s}") for s, size in enumerate(sizes) for k in range(size)
        ]
        return spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")

    agree(frame([1]))
    agree(frame([16]))
    agree(frame([273]))
    agree(frame([1, 17, 1, 300, 16, *[1] * 14]))
    assert {r.verified for r in agree(frame([40, 3]))} == {True, False}
    honest = merkle.proofs(frame([40, 3])).collect()
    assert all(r.verified for r in honest)


def test_copied_nodes_and_equal_rows(spark, monkeypatch):
    """Hot nodes are climbed through in copies, rows equal in every column each have a proof."""
    monkeypatch.setattr(merkle, "CLIMBERS", 2)
    rows = [(k // 3, "hot", "en", 1, "Same") for k in range(700)] + [(None, None, None, None, None)] * 5
    agree(spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string"))


@pytest.mark.parametrize("name", ["cteRecursionLevelLimit", "cteRecursionRowLimit"])
def test_settings_stay(spark, odd, name):
    before = spark.conf.get(f"spark.sql.{name}")
    merkle.proofs(odd).count()
    assert spark.conf.get(f"spark.sql.{name}") == before
