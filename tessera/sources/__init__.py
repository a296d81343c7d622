"""Batch sources and sinks (parquet in, parquet out)."""
