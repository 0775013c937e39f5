"""Structured Streaming forms of the log and feedback operators."""
