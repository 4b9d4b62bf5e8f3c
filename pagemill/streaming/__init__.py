"""Structured Streaming forms of the append and resume rules."""
