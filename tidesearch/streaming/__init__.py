"""Incremental upkeep with Structured Streaming."""
