"""Incremental runs of the table jobs."""
