"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from intakeloom.session import configure


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table as a stream of files.

    A table may be one file or a folder of them: a stream takes a folder, or a
    pattern, which this is, so that it stands for either.
    """
    schema = table(spark, folder, name).schema
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 64)
        .parquet(f"{folder.rstrip('/')}/{name}.parque[t]")
    )
