"""Structured Streaming forms of the log, outcome and alert operators."""
