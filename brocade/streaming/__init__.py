"""Incremental ingest of judge records."""
