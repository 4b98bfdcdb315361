"""Helpers the operators of this package share."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intakeloom.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


#: Keys with more than this part of all rows are hot; there are fewer of them than this number.
HOT = 4096

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SENT: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for an application.

    They may run in other folders and on other machines than the driver's.
    """
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        root = Path(__file__).resolve().parents[2]
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/intakeloom", "zip", root, "intakeloom")
        context.addPyFile(archive)  # the driver serves it to the executors
        _SENT.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    send_package(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as a Parquet table in the folder the cluster shares.

    Cuts the lineage: what reads it again, or after an executor is lost, does
    not repeat the work.  So the shuffle files that made it go when it is done.
    """
    spark = frame.sparkSession
    path = shared_folder(spark, purpose)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path)


def met(held: DataFrame, keys: DataFrame, purpose: str) -> DataFrame:
    """``held`` joined by ``key`` with ``keys`` (key, rows, ...), ``rows`` being how many rows of ``held`` have the key.

    The rows of hot keys are not shuffled: these keys, fewer than ``HOT`` as each has
    more than that part of all rows, are broadcast.
    """
    keys = written(keys, purpose)
    total = keys.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()["rows"]
    is_hot = F.col("rows") * HOT > total
    hot = F.broadcast(keys.where(is_hot).drop("rows"))
    rest = held.join(hot.select("key"), "key", "left_anti").join(keys.where(~is_hot).drop("rows"), "key")
    return held.join(hot, "key").unionByName(rest)
