"""Search in the ledger by an index of character triples, one batch of postings for each batch of records.

A record that contains a text contains all the text's triples.  Postings list,
for a triple, the records that hold it in one of the searched columns; a search
reads the postings of its own triples only, keeps the records that have all of
them, and compares just these with the pattern.  The result is that of a scan.

Postings are files in folders by a hash of the triple, sorted by triple, so the
folder and the files' minimum and maximum leave out nearly all others.  A record
is named by a hash of its id: a collision costs a comparison, not a result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intakeloom import fixed_values as fv
from intakeloom.operators import ledger

SEARCHED = ("source", "intent", "extracted_fields", "sender")
SCHEMA = "gram string, record bigint, batch string, bucket int"
BUCKETS = 64


def grams(text: Column) -> Column:
    """Different triples of neighbouring characters of a text in lower case; none of a shorter or null text."""
    signs = F.split(F.lower(text), "")
    places = F.when(F.size(signs) > 2, F.sequence(F.lit(0), F.size(signs) - 3)).otherwise(F.array().cast("array<int>"))
    triples = F.transform(
        places, lambda k: F.concat(F.get(signs, k), F.get(signs, k + 1), F.get(signs, k + 2))
    )
    return F.when(text.isNotNull(), F.array_distinct(triples)).otherwise(F.array().cast("array<string>"))


def _record(key: Column | str = "id") -> Column:
    return F.xxhash64(key)


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def postings(records: DataFrame) -> DataFrame:
    """``gram, record``; a record that comes more than once repeats its own, which a search counts once.

    So nothing meets here: postings are many times the records.
    """
    found = F.array_distinct(F.flatten(F.array(*[grams(F.col(c)) for c in SEARCHED])))
    return records.select(F.explode(found).alias("gram"), _record().alias("record"))


def add(records: DataFrame, path: str, batch: str) -> None:
    """Write the postings of a batch of records; a batch of the same name is replaced.

    Every version of a record is added: a search finds it by any of them and
    looks at the latest.
    """
    # a range for each task, so a frequent triple is in several files and a rare one in one
    dealt = postings(records).withColumn("bucket", _bucket(F.col("gram"))).repartitionByRange("bucket", "gram", "record")
    dealt.sortWithinPartitions("bucket", "gram", "record").write.mode("overwrite").partitionBy("bucket").parquet(
        f"{path}/batch={batch}"
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def query_grams(spark: SparkSession, query: str) -> list[str]:
    """Triples any hit must hold: those of the pieces between wildcards, folded as the records are."""
    pieces = [piece for piece in re.split("[%_]", query) if piece]
    if not pieces:
        return []
    rows = spark.createDataFrame([(piece,) for piece in pieces], "piece string").select(F.explode(grams(F.col("piece"))).alias("gram"))
    return sorted({row.gram for row in rows.collect()})


def candidates(index: DataFrame, wanted: list[str]) -> DataFrame:
    """Hashes of records that hold all the wanted triples."""
    buckets = [F.lit(gram) for gram in wanted]
    folders = index.sparkSession.range(1).select(*[_bucket(gram).alias(f"b{k}") for k, gram in enumerate(buckets)]).first()
    read_only = index.where(F.col("bucket").isin(*set(folders)) & F.col("gram").isin(*wanted))
    held = read_only.groupBy("record").agg(F.count_distinct("gram").alias("held"))
    return held.where(F.col("held") == len(wanted)).select("record")


def search(records: DataFrame, index: DataFrame, query: str, limit: int = fv.SEARCH_LIMIT) -> DataFrame:
    """What :func:`ledger.search` finds in the latest version of ``records``, by way of the index.

    ``records`` are all versions.  A query without three characters in a row
    has no triples and is answered by the scan.
    """
    wanted = query_grams(records.sparkSession, query)
    if not wanted:
        return ledger.search(ledger.latest(records), query, limit)
    few = records.join(candidates(index, wanted), _record() == F.col("record"), "left_semi")
    return ledger.search(ledger.latest(few), query, limit)
