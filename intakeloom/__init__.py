"""Document intake analytics on Spark: classify, extract, score, record, query."""

__version__ = "0.1.0"
