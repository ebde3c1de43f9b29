"""Structured Streaming forms of the log rules."""
