"""Statistics that are kept up to date: small sums for every batch of the ledger.

A batch of records changes the statistics by what its records add and, for
updates and deletions, by what the versions they replace had added.  Each batch
gets such a table of differences; statistics add these up and never read the
ledger.  Times are summed as decimals, which add up the same in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intakeloom.operators import ledger

KEYS = ["status", "format", "intent"]
SCHEMA = "status string, format string, intent string, records bigint, times decimal(38,9), timed bigint, batch string"


def _differences(records: DataFrame, sign: Column) -> DataFrame:
    time = F.col("processing_time").cast("decimal(28,9)")
    positive = F.col("processing_time") > 0
    return (
        records.groupBy(*KEYS)
        .agg(
            F.sum(sign).alias("records"),
            F.coalesce(F.sum(F.when(positive, time * sign)), F.lit(0)).cast("decimal(38,9)").alias("times"),
            F.coalesce(F.sum(F.when(positive, sign)), F.lit(0)).alias("timed"),
        )
        .where("records <> 0 OR times <> 0 OR timed <> 0")
    )


def append(records: DataFrame, ledger_path: str, path: str, batch: str) -> None:
    """Append a batch to the ledger and its differences to the summaries.

    Records of version 1 replace nothing, so only changed ones are looked up,
    by id and version, in the batches before.  Batches are added one after
    another; one of the same name replaces both its records and its differences.
    """
    spark = records.sparkSession
    ledger.append(records, ledger_path, batch)
    whole = spark.read.schema(_batched()).parquet(ledger_path)
    new = whole.where(F.col("batch") == batch)
    before = new.where("version > 1").select("id", (F.col("version") - 1).alias("version"))
    replaced = whole.join(before, ["id", "version"], "left_semi").where("NOT is_deleted")
    columns = [*KEYS, "processing_time"]
    changes = (
        new.where("NOT is_deleted").select(*columns, F.lit(1).cast("bigint").alias("_sign"))
        .unionByName(replaced.select(*columns, F.lit(-1).cast("bigint").alias("_sign")))
    )
    _differences(changes, F.col("_sign")).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def _batched():
    from pyspark.sql import types as T

    return T.StructType([*ledger.SCHEMA.fields, T.StructField("batch", T.StringType())])


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _mean() -> Column:
    mean = F.sum("times").cast("double") / F.sum("timed")
    return F.coalesce(F.when(F.sum("timed") > 0, F.round(mean, 2)), F.lit(0.0))


def count_by(summaries: DataFrame, column: str) -> DataFrame:
    """As :func:`ledger.count_by` over current records."""
    return summaries.groupBy(column).agg(F.sum("records").alias("count")).where("count > 0")


def statistics(summaries: DataFrame) -> DataFrame:
    """As :func:`ledger.statistics` over current records: facet, value, count, avg_processing_time."""
    spread = summaries.select(
        "records", "times", "timed",
        F.explode(F.array(
            F.struct(F.lit("total").alias("facet"), F.lit(None).cast("string").alias("value")),
            *[F.struct(F.lit(key).alias("facet"), F.col(key).alias("value")) for key in KEYS],
        )).alias("x"),
    )
    found = spread.groupBy("x.facet", "x.value").agg(F.sum("records").alias("count"), _mean().alias("_mean"))
    total = F.col("facet") == "total"
    return found.where(total | (F.col("count") > 0)).select(
        "facet", "value", "count", F.when(total, F.col("_mean")).alias("avg_processing_time")
    )
