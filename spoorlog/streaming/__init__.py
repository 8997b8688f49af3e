"""Structured Streaming forms of the parsers and rules."""
