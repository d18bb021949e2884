"""Incremental ingest-ledger analytics on Spark DataFrames."""
