"""Structured Streaming forms of the ingest, first-seen and daily-sum steps."""
