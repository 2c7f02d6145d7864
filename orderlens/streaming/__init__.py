"""Incremental ingest of order-line files (the reference itself has no streams)."""
