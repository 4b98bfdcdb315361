"""Scoring a text against word lists with substring tests inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from intakeloom.functions.text import has


def hits(lowered: Column, words: list[str]) -> Column:
    """How many of the words occur at least once in the lower-cased text."""
    total = has(lowered, words[0]).cast("int")
    for word in words[1:]:
        total = total + has(lowered, word).cast("int")
    return total


def best_label(lowered: Column, word_lists: dict[str, list[str]], share: bool) -> Column:
    """``struct(score, rank, label)`` of the best list; earlier lists win ties.

    ``share`` divides the number of hits by the length of the list.
    """
    candidates = []
    for rank, (label, words) in enumerate(word_lists.items()):
        score = hits(lowered, words).cast("double")
        if share:
            score = score / F.lit(float(len(words)))
        candidates.append(
            F.struct(score.alias("score"), F.lit(-rank).alias("rank"), F.lit(label).alias("label"))
        )
    return F.array_max(F.array(*candidates))
