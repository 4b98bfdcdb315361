"""All registered queries with the SQL they are checked against."""

from intakeloom.plans import (  # noqa: F401
    queries_classify,
    queries_json,
    queries_ledger,
    queries_mail,
    queries_pages,
    queries_sources,
)
from intakeloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
