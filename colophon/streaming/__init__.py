"""Structured Streaming forms of the operators without state."""
