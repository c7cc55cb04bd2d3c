"""Streamed ingest of landed files."""
