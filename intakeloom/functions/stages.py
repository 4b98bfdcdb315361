"""Keeping a costly column from being computed again by a later filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that filters on it, or on what follows from it, do not recompute.

    A filter moves below the projections it can be expressed through and takes
    their expressions with it, so a condition on the outcome of an extraction
    would run the extraction in the filter and again in the projection.  It
    cannot move below a generator; one that yields its only element pins the
    value and still leaves all other columns to pruning.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))
