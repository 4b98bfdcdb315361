"""Shared quality checks: required fields, mean scores, error rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intakeloom.functions.text import strip


def validate_fields(data: Column, required: list[str]) -> Column:
    """Check a ``map<string, string>`` for required entries.

    ``struct(is_valid, missing_fields, empty_fields, confidence_score)``: the
    share of good required fields (of all entries, when none is required) times
    a half to one for the share of filled entries.
    """
    names = F.array(*[F.lit(name) for name in required]).cast("array<string>")
    missing = F.filter(names, lambda n: ~F.map_contains_key(data, n))
    empty = F.filter(
        names,
        lambda n: F.map_contains_key(data, n) & ~filled(F.try_element_at(data, n)),
    )
    bad = F.size(missing) + F.size(empty)
    entries = F.size(data)
    populated = F.size(F.filter(F.map_values(data), filled))
    total = F.lit(len(required)) if required else entries
    share = F.when(total > 0, F.greatest(F.lit(0.0), F.lit(1.0) - bad / total)).otherwise(
        F.lit(1.0)
    )
    boost = F.when(
        entries > 0, F.lit(0.5) + F.lit(0.5) * (populated / entries)
    ).otherwise(F.lit(1.0))
    return F.struct(
        (bad == 0).alias("is_valid"),
        missing.alias("missing_fields"),
        empty.alias("empty_fields"),
        F.least(F.lit(1.0), share * boost).alias("confidence_score"),
    )


def filled(value: Column) -> Column:
    return F.coalesce(F.length(strip(value)) > 0, F.lit(False))


def mean_score(factors: Column) -> Column:
    """Mean of a ``map<string, double>`` clamped to [0, 1]; 0 for an empty map."""
    total = F.aggregate(F.map_values(factors), F.lit(0.0), lambda acc, x: acc + x)
    count = F.size(factors)
    return F.when(count == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / F.nullif(count, F.lit(0))))
    )


def error_rows(
    failed: DataFrame, message: Column, agent: str, context: str = "Agent processing"
) -> DataFrame:
    """Standard result of a failure, in place of the extraction columns."""
    return failed.withColumns(
        {
            "success": F.lit(False),
            "error": F.concat(F.lit(f"{context}: "), message),
            "extracted_fields": F.lit("{}"),
            "confidence_score": F.lit(0.0),
            "agent": F.lit(agent),
            "status": F.lit("ERROR"),
        }
    )
