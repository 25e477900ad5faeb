"""Incremental ingest and windowed event queries."""
