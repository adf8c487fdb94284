"""Incremental day loads."""
