"""Structured Streaming forms of event operators."""
