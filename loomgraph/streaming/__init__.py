"""Paged and streamed delivery and ingest."""
