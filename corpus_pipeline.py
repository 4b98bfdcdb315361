"""From documents to token ids: the stages of the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intakeloom.llm import bpe, jaccard, mixing, passages, templates, toxicity
from intakeloom.llm.queries import vocabulary
from intakeloom.llm.shared import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents judged toxic go."""
    judged = toxicity.scored(docs, table(spark, sf_dir, "labels"))
    return judged.where("toxicity_score < 0.5").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates and passages of 50 words met before go; every document stays, if only with an empty text."""
    without = written(templates.without_recurring(docs).select(*docs.columns), "pipeline-lines")
    without = passages.without_passages(without)
    return without.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words a shingle, similarity 0.8."""
    return jaccard.one_of_each(docs, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a document taken twice comes twice."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and hash of every document's token ids, and the hash of the decoded bytes."""
    return bpe.digests(docs.select("doc_id", "source", "text"), *vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean),
    ("line dedup", lines),
    ("n-gram Jaccard join", distinct),
    ("mixing", mix),
    ("byte-level BPE", tokens),
]

#: The first stage applies a fitted model, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-stage")
    return STAGES[-1][1](spark, docs, sf_dir)
