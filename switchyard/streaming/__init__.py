"""Structured Streaming forms of the route log operators."""
