"""Continuous indexing and log following on Structured Streaming."""
