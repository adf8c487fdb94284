"""Readers of raw payloads and files, and partitioned sinks."""
