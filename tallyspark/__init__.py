"""Spark-first ledger analytics: message ingestion, a JSON analytics language, time series and vector operators."""

__version__ = "0.1.0"
