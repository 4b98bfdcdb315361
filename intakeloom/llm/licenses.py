"""License scan: an exact set-similarity join of text blocks with license templates.

A text's words are cut into overlapping blocks.  A block meets a template when
it holds at least the template's ``percent`` of its different words; a short
phrase must be held whole, and its words must then stand one after another.

* *Order*: the templates' words are put in one order, rarest first by the number
  of documents that hold them, counted over all documents.
* *Prefix*: a template of ``n`` words that needs ``m`` of them shares one of its
  first ``n - m + 1`` words with every block it meets, and that word is among the
  block's own first ones.  Documents without any such word are left at once.
* *Length and position*: a block must hold ``m`` words of templates at all, and
  enough of them must be left behind the first shared word in both orders.
* *Verification*: what passes is counted exactly, once for block and template (at
  their first shared word).  The filters change the cost, not the result.

Only templates, their words and their counts are broadcast or brought to the
driver: a parameter of some kilobytes, limited to ``MOST_WORDS`` words.  Blocks
are made in place and never shuffled; what is shuffled is one slim row for each
meeting and document.

* Words are runs of digits, letters a-z (A-Z count as these) and all signs
  beyond ASCII.  Templates of more than ``STEP`` words are cut into parts, each
  of which gives the label; any run of ``STEP`` words lies whole in a block.
* A null text counts as empty: no words, nothing found, score 0.  Repeated rows
  and rows without an id give one row each.  Texts are read whole; other columns
  take no part, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intakeloom.functions.stages import computed_once

BLOCK, STEP, PERCENT, MOST_WORDS = 64, 32, 80, 20_000

#: Words of a text that is lower-cased already, and of any text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and labels of the contract, then the opening words of public license notices.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICES = {
    "This work is licensed under the GNU General Public License, version 3": "gpl-3-statement",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation": "gpl-notice",
    "Licensed under the Apache License, Version 2.0": "apache-2.0-statement",
    "you may not use this file except in compliance with the License. You may obtain a copy of the License at": "apache-notice",
    "Licensed under CC BY-NC 4.0": "cc-by-nc-4.0-statement",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4.0-statement",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa-4.0-statement",
    "Released under the MIT License": "mit-statement",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files, to deal in the Software without restriction": "mit-notice",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met": "bsd-notice",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice": "isc-notice",
    "This Source Code Form is subject to the terms of the Mozilla Public License": "mpl-notice",
    "This is free and unencumbered software released into the public domain": "unlicense-notice",
}


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    #: A phrase, whose words must stand one after another.
    phrase: bool
    #: Different words a block must hold.
    need: int


def words_of(text: str) -> list[str]:
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def templates(phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, percent: int = PERCENT) -> list[Template]:
    found = []
    for text, label in phrases.items():
        words = tuple(words_of(text))
        if not 1 <= len(words) <= STEP:
            raise ValueError(f"a phrase has 1 to {STEP} words: {text}")
        found.append(Template(label, words, True, len(set(words))))
    for text, label in notices.items():
        words = words_of(text)
        for start in range(0, len(words), STEP):
            part = tuple(dict.fromkeys(words[start : start + STEP]))
            found.append(Template(label, part, False, -(-len(part) * percent // 100)))
    if sum(len(one.words) for one in found) > MOST_WORDS:
        raise ValueError(f"the templates have more than {MOST_WORDS} words")
    return found


def words(text: Column) -> Column:
    """The words, in lower case where a template's word could be meant.

    ``lower`` is fast and differs from folding A-Z alone only beyond ASCII; of
    those signs the Kelvin sign alone would become a letter.
    """
    folded = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e5")))
    return F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))


def literal(values: list[str]) -> Column:
    return F.array(*[F.lit(value) for value in values]).cast("array<string>")


def by_rarity(docs: DataFrame, given: list[Template]) -> list[str]:
    """The templates' words, the rarest in ``docs`` first, ties by the word."""
    vocabulary = sorted({word for one in given for word in one.words})
    met = docs.select(F.explode(F.array_intersect(words(F.col("text")), literal(vocabulary))).alias("word"))
    counts = {row["word"]: row["n"] for row in met.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda word: (counts.get(word, 0), word))


def prefixes(docs: DataFrame, given: list[Template], order: list[str]) -> DataFrame:
    """Each template's first words in the common order, with what is needed to verify it."""
    place = {word: k for k, word in enumerate(order)}
    rows = []
    for one in given:
        ordered = sorted(set(one.words), key=place.__getitem__)
        rows += [
            (word, one.label, one.phrase, list(one.words), ordered, rank, one.need)
            for rank, word in enumerate(ordered[: len(ordered) - one.need + 1])
        ]
    schema = "word string, label string, phrase boolean, sequence array<string>, template array<string>, rank int, need int"
    return docs.sparkSession.createDataFrame(rows, schema)


def meetings(docs: DataFrame, given: list[Template] | None = None) -> DataFrame:
    """A row for every block and template that meet, and at least one for every document.

    Columns: row (a number for each row of ``docs``), doc_id, n_words, label,
    phrase, start and size of the block in words, containment, and places: where
    a phrase's words begin (only in the block's first ``STEP`` words, so that each
    place comes once).  A document without a meeting has nulls there.
    """
    given = templates() if given is None else given
    order = by_rarity(docs, given)
    first = prefixes(docs, given, order)
    telling = sorted({row["word"] for row in first.select("word").collect()})
    least = min((one.need for one in given), default=1)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    rows = computed_once(rows, "words", words(F.col("text")))
    cut = F.transform(
        F.sequence(F.lit(0), F.expr(f"(size(words) - 1) div {STEP}").cast("int")),
        lambda k: F.struct((k * STEP).alias("start"), F.slice("words", k * STEP + 1, BLOCK).alias("words")),
    )
    rows = rows.select(
        "row",
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.explode_outer(F.when(F.arrays_overlap("words", literal(telling)), cut)).alias("block"),
    )
    rows = computed_once(rows, "held", F.array_intersect(literal(order), F.col("block.words")))
    head = F.slice("held", 1, F.greatest(F.size("held") - least + 1, F.lit(0)))
    rows = rows.select("*", F.posexplode_outer(head).alias("place", "word"))

    behind = F.least(F.size("template") - F.col("rank"), F.size("held") - F.col("place"))
    common = F.array_intersect("held", "template")
    met = rows.join(
        F.broadcast(first.withColumnRenamed("word", "shared")),
        (F.col("word") == F.col("shared"))
        & (F.size("held") >= F.col("need"))
        & (behind >= F.col("need"))
        & (F.get(common, F.lit(0)) == F.col("word"))
        & (F.size(common) >= F.col("need")),
        "left",
    )
    places = F.filter(
        F.sequence(F.lit(0), F.lit(STEP - 1)),
        lambda k: F.slice("block.words", k + 1, F.size("sequence")) == F.col("sequence"),
    )
    places = F.when(F.col("phrase"), F.transform(places, lambda k: (k + F.col("block.start")).cast("bigint")))
    return met.select(
        "row",
        "doc_id",
        "n_words",
        "label",
        "phrase",
        F.when(F.col("label").isNotNull(), F.col("block.start").cast("bigint")).alias("start"),
        F.when(F.col("label").isNotNull(), F.size("block.words")).alias("size"),
        (F.size(common) / F.size("template")).alias("containment"),
        places.alias("places"),
    )


def scanned(docs: DataFrame, given: list[Template] | None = None) -> DataFrame:
    """Every document with its number of words, places and labels of phrases, all labels, and the best containment."""
    found = computed_once(meetings(docs, given), "n", F.when(F.col("phrase"), F.size("places")).otherwise(0))
    counts = F.col("label").isNotNull() & (~F.col("phrase") | (F.col("n") > 0))
    label = F.when(counts, F.col("label"))
    return (
        found.groupBy("row", "doc_id", "n_words")
        .agg(
            F.sum("n").cast("bigint").alias("n_base"),
            F.min(F.when(F.col("phrase"), F.array_min("places"))).alias("first_word"),
            F.max(F.when(F.col("phrase"), F.array_max("places"))).alias("last_word"),
            F.array_sort(F.collect_set(F.when(F.col("phrase"), label))).alias("base_labels"),
            F.array_sort(F.collect_set(label)).alias("labels"),
            F.coalesce(F.max(F.when(counts, F.col("containment"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
