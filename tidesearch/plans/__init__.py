"""Composite queries: search, reports, batch ingest."""
