"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its whole numbers become bigint as in the SQL."""

    def wrap(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            result = function(spark, folder)
            return result.select(
                *[
                    F.col(f.name).cast("bigint").alias(f.name)
                    if isinstance(f.dataType, _INTEGERS)
                    else F.col(f.name)
                    for f in result.schema.fields
                ]
            )

        run.__name__ = name
        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return wrap


def joined(values: Column | str, sort: bool = False) -> Column:
    """A list as text, so that results compare by value."""
    column = F.col(values) if isinstance(values, str) else values
    return F.array_join(F.array_sort(column) if sort else column, "|")


def stamp(value: Column | str) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")
